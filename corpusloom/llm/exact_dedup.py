"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by a SHA-256 digest. A batch is reduced to
one row per digest (partial aggregation first, so a hot text is one row per task), joined
against the index by sort-merge anti-join, and what is new is appended. Texts never move:
only digests and ids are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

#: Runs of white space other than one plain space.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with white-space runs made one space; null is empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_SPACE, " ")
    return F.unhex(F.sha2(plain, 256))


class DigestIndex:
    """Digests seen so far, with the id that stands for each and the batch that brought it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        """Open the index at ``path``, or start an empty one.

        ``buckets`` and ``id_type`` must be the same each time. About 2 million digests a
        bucket are sorted without spilling; choose the count for the final size.
        """
        self.spark, self.buckets = spark, buckets
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, "
            f"batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def admit(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch; one verdict per row: doc_id, keep_id, group_size, kept, text_sha256.

        Of equal texts in a batch the row with the smallest id stays (null ids last; of rows
        that share the id, one), unless an earlier batch brought the text: then none stays and
        ``keep_id`` names the earlier row. ``group_size`` counts rows of this batch. A null
        text is an empty text. Other columns are ignored. An empty batch gives no rows.
        Admitting a batch again after a failure gives the same verdicts and adds nothing.
        """
        rows = materialize(
            docs.select(
                F.col(key).alias("doc_id"),
                text_digest(F.col(text)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            )
        )
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        groups = materialize(
            rows.groupBy("digest")
            .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "first.doc_id", "first.row", "group_size")
        )
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti").select(
            "digest", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("batch")
        )
        # hash partitioning by the bucket column: one file a bucket
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        known = groups.withColumnRenamed("row", "keep_row").drop("doc_id").join(
            self.rows().hint("merge"), "digest"
        )
        # lone new texts need no partner; what is left is small or split by AQE when hot
        notable = known.where((F.col("group_size") > 1) | (F.col("batch") != batch)).select(
            "digest",
            "keep_id",
            "group_size",
            F.when(F.col("batch") == batch, F.col("keep_row")).otherwise(F.lit(-1)).alias("keep_row"),
        )
        lone = F.col("group_size").isNull()
        return rows.join(notable, "digest", "left").select(
            "doc_id",
            F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (lone | (F.col("row") == F.coalesce("keep_row", F.lit(-1).cast("long")))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def kept_rows(docs: DataFrame, verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, one for each kept verdict.

    Ids that stand on several rows are settled by id and text: of equal texts one row stays.
    Rows with a null id are matched by text alone.
    """
    held = [c for c in docs.columns]
    marked = docs.select(F.struct(*held).alias("d"))
    ids = F.col(f"d.{key}")
    kept = verdicts.where("kept").select(
        F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")
    )
    repeated = (
        marked.groupBy(ids.alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) | F.col("_id").isNull()).select("_id")
    )
    repeated = materialize(repeated)
    odd = F.col("_odd").isNotNull()
    tagged = marked.withColumn("_id", ids).join(
        repeated.select(F.col("_id").alias("_r"), F.lit(True).alias("_odd")),
        F.col("_id").eqNullSafe(F.col("_r")),
        "left",
    )
    plain = tagged.where(~odd).join(kept.select("_id"), "_id", "left_semi").select("d")
    settled = (
        tagged.where(odd).withColumn("_digest", text_digest(F.col("d.text")))
        .dropDuplicates(["_id", "_digest"])
    )
    wanted = kept.select(F.col("_id").alias("_k"), F.col("_digest").alias("_kd"))
    settled = settled.join(
        wanted,
        F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_kd")),
        "left_semi",
    ).select("d")
    return plain.unionByName(settled).select("d.*")
