"""Rows that every operator must take: nulls, empties, long texts, ties, clashing columns."""

import pytest


@pytest.fixture(scope="session")
def table(spark):
    def make(texts, first=0, **extra):
        """Documents with ids from ``first``; a pair gives its own id; extra columns added."""
        from pyspark.sql import functions as F

        rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make
