"""Documents to packed training data: quality, copies, near copies, benchmark passages, batches.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again, so a stage can be repeated alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_cnn, exact_dedup, fm_index, jaccard_join, length_buckets
from corpusloom.llm.queries import contaminated, held_out_quality, hit_words
from corpusloom.runtime import materialize, scratch_dir, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the byte network rejects (a score under one half)."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return byte_cnn.keep_good(docs, byte_cnn.train(docs, labels, "quality", held_out_quality))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, keep the row with the smallest id."""
    index = exact_dedup.DigestIndex(spark, f"{scratch_dir(spark)}/digests-{uuid.uuid4().hex}", buckets=64)
    return exact_dedup.kept_rows(docs, index.admit(docs, batch="documents"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, keep the row with the smallest id (null ids last)."""
    small_batches(spark)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if odd.where((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        found = jaccard_join.near_classes(docs)
        gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # ids that do not name one row: number the rows
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("doc_id"), "text")
    found = jaccard_join.near_classes(named)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id._row")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents: benchmark windows cover a twentieth of their words or more."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # the text goes to the tasks' Python once, the other columns beside it
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*others).alias("row"))
    found = fm_index.decontaminate(docs.select("doc_id", "text", rest.alias("rest")), benchmark, keep=("rest",), with_text=True)
    text = F.when(~F.col("rest.no_text"), F.col("text")).alias("text")
    clean = found.where(~contaminated(F.col("n_words"), hit_words("spans")))
    return clean.select(*[text if c == "text" else F.col("rest.row")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document left."""
    return length_buckets.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]

#: The network has no SQL form; tests/llm/test_pipeline.py checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
