"""The stored index gives what a search over the texts gives, and skips blocks."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.operators.lexical_index import LexicalIndex


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [" ".join(draw.choices(words, weights, k=draw.choice([0, 3, 10, 40]))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(1500, 1))) + [(5000, None), (5001, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "w90 w120 w3"), (2, "w0 w1"), (3, "w150 w150 w0"), (4, "unseen"), (5, ""), (6, "w7")]
    return spark.createDataFrame(rows, "query_id bigint, query string")


def rows_of(hits):
    return sorted((r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in hits.collect())


@pytest.mark.parametrize("block", [4, 128])
def test_same_hits_and_skipped_blocks(spark, tmp_path, docs, queries, block):
    index = LexicalIndex(spark, str(tmp_path / "index"), stop=[], block=block)
    index.add(docs, "all")
    for k in (1, 5):
        hits, report = index.search(queries, k)
        want = search.bm25_search(queries, docs.where(F.col("text").isNotNull()).unionByName(docs.where(F.col("text").isNull())), k, stop=[])
        assert rows_of(hits) == rows_of(want)
        seen = report.first()
        assert 0 < seen.read <= seen.blocks
    if block == 4:  # the best of one word stand in few of its blocks
        _, report = index.search(queries.where("query_id = 6"), 5)
        seen = report.first()
        print("blocks", seen.blocks, "read", seen.read)
        assert seen.read < seen.blocks / 2


def test_batches_are_appended_and_replaced(spark, tmp_path, docs, queries):
    index = LexicalIndex(spark, str(tmp_path / "index"), stop=[], block=8)
    first, second = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    index.add(first, "a")
    assert rows_of(index.search(queries)[0]) == rows_of(search.bm25_search(queries, first, stop=[]))
    index.add(first, "b")
    index.add(second, "b")  # takes the place of the wrong batch
    assert rows_of(index.search(queries)[0]) == rows_of(search.bm25_search(queries, docs, stop=[]))


def test_words_in_most_documents(spark, tmp_path):
    """A word in more than half of the documents gets a share of the mean, here below zero."""
    rows = [(i, "common " + ("rare" if i == 3 else "usual")) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "common rare usual")], "query_id bigint, query string")
    index = LexicalIndex(spark, str(tmp_path / "index"), stop=[], block=2)
    index.add(docs, "all")
    assert rows_of(index.search(queries)[0]) == rows_of(search.bm25_search(queries, docs, stop=[]))


def test_plan_reads_only_the_words_asked_for(spark, tmp_path, docs, queries):
    index = LexicalIndex(spark, str(tmp_path / "index"), stop=[], block=64)
    index.add(docs, "all")
    hits, _ = index.search(queries.where("query_id = 6"), 3)
    assert {r.query_id for r in hits.collect()} == {6}
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    sizes = stored.where("word = 'w0'").select("n", "most", "least", F.array_max("tfs").alias("m"), F.array_min("dls").alias("l")).collect()
    assert len(sizes) > 1 and all(r.n <= 64 and r.most == r.m and r.least == r.l for r in sizes)
