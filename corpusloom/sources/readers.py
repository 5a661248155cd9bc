"""Sources, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.functions import vectors as V
from corpusloom.functions.text import as_text

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else ISO-8859-1 (which never fails); newlines become ``\\n``."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def read_books(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row ``(file_name, text)`` per text file."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path"), name.alias("file_name"), decode_text(F.col("content")).alias("text"))


def read_csv_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.PROCESSED,
    prefix: str = "",
    suffix: str = ".csv",
) -> DataFrame:
    """All CSV files of a folder with a given prefix and suffix, plus their ``file_name``."""
    files = spark.read.schema(schema).options(**_CSV).option("pathGlobFilter", f"{prefix}*{suffix}").csv(path)
    return files.withColumn("file_name", F.col("_metadata.file_name"))


def chapter_of_file(name: Column, prefix: str = "processed_chapter_", suffix: str = ".csv") -> Column:
    """Chapter id in a file name."""
    return F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit(""))


def read_chapter_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table written one folder per chapter; ``chapter_no`` comes from the path."""
    whole = T.StructType([*schema.fields, T.StructField("chapter_no", T.IntegerType())])
    return spark.read.schema(whole).options(**_CSV).csv(path)


def read_association(spark: SparkSession, path: str) -> DataFrame:
    """Word pairs with a DOUBLE score as ``(word1, word2, mi_score)``."""
    return spark.read.schema(schemas.ASSOCIATION).options(**_CSV).csv(path).withColumnRenamed("MI_score", "mi_score")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The embedding store."""
    return spark.read.parquet(path)


def read_embedded_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.EMBEDDED, column: str = "embedding"
) -> DataFrame:
    """Sentences with their vectors parsed from text; bad cells become null."""
    rows = spark.read.schema(schema).options(**_CSV).csv(path)
    return rows.withColumn("sentence", as_text(F.col("sentence"))).withColumn(column, V.parse(F.col(column)))


def bad_vectors(df: DataFrame, text: str, vector: str) -> DataFrame:
    """How many non-null cells failed to parse."""
    return df.agg(F.count_if(F.col(text).isNotNull() & F.col(vector).isNull()).alias("n_bad"))


def read_similarity(spark: SparkSession, path: str, part: str = "pairs") -> DataFrame:
    """The ``pairs`` or ``averages`` that ``write_similarity`` has written."""
    return spark.read.parquet(f"{path}/{part}")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """First paragraph of every record of (gzipped) JSON lines."""
    records = spark.read.schema(schemas.PARAGRAPH_RECORD).json(path)
    return records.select(F.try_element_at("paragraphs", F.lit(1)).alias("text"))


def read_corpus(spark: SparkSession, path: str, column: str = "text", fmt: str = "parquet") -> DataFrame:
    """Rows with a text field."""
    rows = spark.read.format(fmt)
    if fmt != "parquet":
        rows = rows.schema(T.StructType([T.StructField(column, T.StringType())]))
    return rows.load(path).filter(F.col(column).isNotNull())
