import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom import runtime

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def largest_batch(df):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return df.mapInArrow(size, "n bigint").agg(F.max("n")).first()[0]


def test_a_limit_of_the_session_stays(limit):
    runtime.small_batches(limit)
    assert limit.conf.get(LIMIT) == "4m"
    limit.conf.set(LIMIT, "1m")
    runtime.small_batches(limit)
    assert limit.conf.get(LIMIT) == "1m"


def test_stages_hand_texts_to_python_in_small_batches(limit, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.concat(F.lit("w"), x + F.col("id") * 10000)))
    rows = limit.range(0, 1200, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    limit.createDataFrame([(1, "one two")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_passages(limit, rows, str(tmp_path))
    assert clean.count() == 1200
    assert largest_batch(rows) < 6e6
