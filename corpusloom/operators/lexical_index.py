"""A stored inverted index for BM25, with blocks that a search can skip.

The texts are tokenised once, when a batch is added. What is kept: the counted words of each
document, and for every word its postings in order of weight, cut into blocks. A block says the
largest count and the shortest document it holds, which bounds every score in it whatever the
average length has become since. A search scores the documents of the heaviest blocks of each query
word, takes their k-th best score as a floor, and reads only blocks that can still lift a document
over it.

Tables are Parquet, sorted by word over range partitions, so that a search reads the row groups of
its words and the blocks of a frequent word are many rows in many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.search import EPSILON, K1, B, bm25_idf, top_hits
from corpusloom.runtime import materialize, materialize_counted

BLOCK = 128
_SENT_ROWS = 1 << 20


class LexicalIndex:
    """Postings, counted words and word statistics below one folder, a part for each batch."""

    def __init__(self, spark: SparkSession, path: str, stop: list[str] | None = None, block: int = BLOCK):
        self.spark, self.path, self.stop, self.block = spark, path.rstrip("/"), stop, block

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text: str = "text") -> None:
        """Index a batch. Adding a batch again replaces it; ids must be unique over all batches."""
        terms = docs.select(F.col(id_col).cast("long").alias("id"), X.search_tokens(F.col(text), self.stop).alias("t")).mapInArrow(
            _counted, "id long, dl int, words array<string>, tfs array<int>"
        )
        self._write(terms, "terms", batch)
        terms = self._batch("terms", batch)
        lengths = terms.agg(F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"))
        usual = lengths.select(F.col("total_length") / F.greatest("df", F.lit(1))).scalar()
        postings = terms.select("id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("p")).select(
            F.col("p.words").alias("word"), "id", F.col("p.tfs").alias("tf"), "dl"
        )
        order = ["word", F.desc("weight"), "id"]
        sorted_ = postings.withColumn("weight", _part(F.col("tf"), F.col("dl"), usual)).repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = sorted_.select("word", "id", "tf", "dl").mapInArrow(
            _blocked(self.block), "word string, n int, ids array<long>, tfs array<int>, dls array<int>, most int, least int"
        )
        self._write(blocks, "postings", batch)
        counted = self._batch("postings", batch).groupBy("word").agg(F.sum("n").alias("df"))
        self._write(
            counted.select("word", "df", F.lit(None).cast("long").alias("total_length"))
            .unionByName(lengths.select(F.lit(None).cast("string").alias("word"), "df", F.col("total_length").cast("long"))),
            "words", batch,
        )

    def _write(self, df: DataFrame, table: str, batch: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _batch(self, table: str, batch: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/batch={batch}")

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def search(
        self, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B, epsilon: float = EPSILON, id_col: str = "doc_id"
    ) -> tuple[DataFrame, DataFrame]:
        """The best ``k`` documents ``(query_id, id, score, rank)`` of ``queries(query_id, query)``,
        as a search over all texts would give them, and ``(blocks, read)``: blocks of the query
        words, and how many of them were read."""
        stats = materialize(
            self._all("words").groupBy("word").agg(F.sum("df").alias("df"), F.sum("total_length").alias("total_length"))
        )
        usual = stats.where(F.col("word").isNull()).agg(F.max("total_length") / F.max("df")).scalar()
        asked = (
            queries.select("query_id", F.explode(X.search_tokens(F.col("query"), self.stop)).alias("word"))
            .groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("qtf"))
            .join(bm25_idf(stats, epsilon), "word")
            .select("query_id", "word", (F.col("qtf") * F.col("idf")).alias("gain"))
        )
        asked = materialize(asked)
        send = F.broadcast if asked.count() <= _SENT_ROWS else (lambda df: df)
        part = lambda tf, dl: F.col("gain") * _part(tf, dl, usual, k1, b)
        briefs = materialize(
            self._all("postings").select("word", "batch", "n", "most", "least", F.get("ids", F.lit(0)).alias("head"))
            .join(send(asked), "word")
            .withColumn("bound", part(F.col("most"), F.col("least")))
        )
        best = briefs.groupBy("query_id", "word", "gain").agg(F.max("bound").alias("top"))
        rest = best.withColumn("rest", F.sum("top").over(Window.partitionBy("query_id")) - F.col("top"))
        # the floor: scores of the documents in the heaviest blocks; without it if a gain is negative
        heaviest = Window.partitionBy("query_id", "word").orderBy(F.desc("bound"), "batch", "head")
        heavy = briefs.withColumn("r", F.row_number().over(heaviest)).where(F.col("r") <= 2 * -(-k // self.block))

        def scored(hits: DataFrame) -> DataFrame:
            """Whole scores of (query_id, id), from the counted words of the documents."""
            found, n = materialize_counted(hits.select("query_id", "id").distinct())
            ids = found.select("id").distinct()
            terms = self._all("terms").join(F.broadcast(ids) if n <= _SENT_ROWS else ids, "id", "left_semi").select(
                "id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("p")
            )
            known = terms.select("id", "dl", F.col("p.words").alias("word"), F.col("p.tfs").alias("tf")).join(send(asked), "word")
            return (
                known.join(found, ["query_id", "id"], "left_semi").groupBy("query_id", "id")
                .agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 6).alias("score"))
            )

        seen = scored(self._read(heavy))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floor = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
        signs = best.groupBy("query_id").agg(F.min("gain").alias("least_gain"))
        floors = signs.join(floor, "query_id", "left").select(
            "query_id", F.when(F.col("least_gain") >= 0, F.col("floor")).alias("floor")
        )
        wanted = materialize(
            briefs.join(rest, ["query_id", "word", "gain"]).join(floors, "query_id")
            .where(F.col("floor").isNull() | (F.col("bound") + F.col("rest") >= F.col("floor") - 2e-6))
            .select("query_id", "word", "gain", "batch", "head")
        )
        scores = scored(self._read(wanted)).withColumnRenamed("id", id_col)
        report = briefs.agg(F.count(F.lit(1)).alias("blocks")).withColumn("read", wanted.agg(F.count(F.lit(1))).scalar())
        return top_hits(scores, k, id_col), report

    def _read(self, wanted: DataFrame) -> DataFrame:
        """Postings of the blocks named by (word, batch, head); Spark sends the names if they are few."""
        names = wanted.select("query_id", "gain", "word", "batch", F.col("head").alias("_head"))
        rows = self._all("postings").withColumn("_head", F.get("ids", F.lit(0))).join(names, ["word", "batch", "_head"])
        return rows.select("query_id", "word", "gain", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select(
            "query_id", "word", "gain", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")
        )


def _part(tf: Column, dl: Column, usual: Column, k1: float = K1, b: float = B) -> Column:
    """Weight of a word in a document, before its idf: grows with the count, falls with the length."""
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / usual))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the counted words of each document."""
    for batch in batches:
        said = [Counter(t or ()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([c.total() for c in said], pa.int32()),
                pa.array([list(c) for c in said], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in said], pa.list_(pa.int32())),
            ],
            ["id", "dl", "words", "tfs"],
        )


def _blocked(size: int):
    """Arrow function over postings sorted by word and weight: blocks of up to ``size``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).dictionary_encode().indices.to_numpy()
            ids, tfs, dls = (batch.column(i) for i in (1, 2, 3))
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, int)
            ends = np.append(new[1:], len(word))
            starts = np.concatenate([np.arange(a, z, size) for a, z in zip(new, ends)]) if len(new) else new
            offsets = pa.array(np.append(starts, len(word)).astype(np.int32))
            n = np.diff(np.append(starts, len(word)))
            if not len(starts):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(starts)),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, ids),
                    pa.ListArray.from_arrays(offsets, tfs),
                    pa.ListArray.from_arrays(offsets, dls),
                    pa.array(np.maximum.reduceat(tfs.to_numpy(), starts)),
                    pa.array(np.minimum.reduceat(dls.to_numpy(), starts)),
                ],
                ["word", "n", "ids", "tfs", "dls", "most", "least"],
            )

    return cut
