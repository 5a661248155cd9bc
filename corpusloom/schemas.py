"""Explicit schemas of the tables that pass between stages."""

from pyspark.sql import types as T

CHAPTERS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("chapter_no", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

SENTENCES = T.StructType(
    [
        T.StructField("sentence_id", T.IntegerType()),
        T.StructField("sentence", T.StringType()),
    ]
)

PROCESSED = T.StructType(
    [
        *SENTENCES.fields,
        T.StructField("cleaned_sentence", T.StringType()),
        T.StructField("tokens", T.StringType()),
    ]
)

EMBEDDED = T.StructType(
    [
        *PROCESSED.fields,
        T.StructField("character", T.StringType()),
        T.StructField("place", T.StringType()),
        T.StructField("embedding", T.StringType()),
    ]
)

TERM_FREQUENCY = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("frequency", T.LongType()),
    ]
)

ASSOCIATION = T.StructType(
    [
        T.StructField("word1", T.StringType()),
        T.StructField("word2", T.StringType()),
        T.StructField("MI_score", T.DoubleType()),
    ]
)

PARAGRAPH_RECORD = T.StructType([T.StructField("paragraphs", T.ArrayType(T.StringType()))])
