"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "emptyValue": ""}


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays: tokens are joined by spaces, mention lists by commas."""
    for name, kind in df.dtypes:
        if kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, " " if name == "tokens" else ", "))
        elif kind.startswith("array<"):
            df = df.withColumn(name, F.to_json(name))
    return df


def write_chapter_csv(df: DataFrame, path: str, by: str = "chapter_no") -> None:
    """One CSV folder per chapter."""
    _flat(df).write.mode("overwrite").options(**_CSV).partitionBy(by).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV table (in the order of the rows)."""
    _flat(df).write.mode("overwrite").options(**_CSV).csv(path)


def write_embeddings(df: DataFrame, path: str, by: str = "chapter_no") -> None:
    """The embedding store, partitioned by chapter; also serves as the combined table."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_similarity(pairs: DataFrame, summary: DataFrame, path: str, averages: DataFrame | None = None) -> None:
    """Pair table (and each row's average similarity) as Parquet, the per-chapter summary as JSON."""
    if averages is not None:
        averages.write.mode("overwrite").parquet(f"{path}/averages")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_paragraphs(df: DataFrame, path: str, column: str = "paragraphs") -> None:
    """Gzipped JSON lines ``{"paragraphs": [...]}``."""
    df.select(F.col(column).alias("paragraphs")).write.mode("overwrite").option("compression", "gzip").json(path)
