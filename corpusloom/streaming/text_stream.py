"""Text operators on a stream.

Cleaning, tokenising and tagging are column expressions and run on ``readStream`` as they
are; term frequency becomes a running aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.operators.corpus import word_counts


def read_text_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def running_term_frequency(stream: DataFrame, text: str = "text", language: str = "english") -> DataFrame:
    """``(word, frequency)`` over everything seen so far (output mode ``complete``/``update``)."""
    return word_counts(stream.select(X.clean_tokens(F.col(text), language).alias("tokens")))
