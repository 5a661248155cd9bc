"""Recall of the approximate neighbours against the exact ones, and the work they take."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import descent, graph, search
from corpusloom.operators import similarity as S

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


def recall(exact, found, k):
    """Share of exact neighbours found; one as near as the k-th counts, whichever it is."""
    floor = exact.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("want"))
    hit = found.join(floor, "query_id").groupBy("query_id").agg(
        F.count_if(F.col("score") >= F.col("floor") - 1e-6).alias("got"), F.max("want").alias("want")
    )
    row = floor.join(hit.drop("want"), "query_id", "left").agg(
        (F.sum(F.least(F.coalesce("got", F.lit(0)), "want")) / F.sum("want")).alias("r"), F.max("want").alias("k")
    ).first()
    assert row.k == k
    return row.r


def clouds(spark, n, seed=5, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 100, dim)) * 2
    x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, dim)) * 0.6
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(6)


@pytest.mark.skipif(not os.path.isfile(TABLE), reason="no test tables")
@pytest.mark.parametrize("k", [10, 50])
def test_recall_on_the_given_vectors(spark, k):
    df = spark.read.parquet(TABLE).select(F.col("vec_id").alias("id"), "embedding")
    exact = S.neighbours(df, k).cache()
    found = S.neighbours(df, k, approximate=True)
    r = recall(exact, found, k)
    print("recall", k, r)
    assert r >= 0.9


def test_work_grows_slower_than_pairs(spark):
    compared = {}
    for n in (1500, 6000):
        df = clouds(spark, n)
        rows = S._prepared(df, "id", "embedding", "euclidean", None)
        lists, compared[n] = descent.descend(rows, 10, "euclidean")
        exact = S.neighbours(df, 10, metric="euclidean")
        assert recall(exact, lists, 10) >= 0.9
    print("compared", compared)
    assert compared[6000] < 8 * compared[1500]  # pairs grow 16 times
    assert compared[6000] < 6000**2 / 2


def test_groups_copies_and_a_hub(spark, monkeypatch):
    """Groups stay apart, copies share their list, and a row near all others is split."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] = 0.01
    x[300:] = x[300]
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, grp int")
    exact = S.neighbours(df, 5, metric="euclidean", group="grp")
    found = S.neighbours(df, 5, metric="euclidean", group="grp", approximate=True).cache()
    assert recall(exact, found, 5) >= 0.9
    assert found.where(F.col("query_id") % 2 != F.col("id") % 2).isEmpty()
    assert found.groupBy("query_id").count().where("count <> 5").isEmpty()


def test_meetings_of_a_hub_are_parts(spark):
    edges = [(i, 0, 0.5, True) for i in range(1, 201)] + [(0, j, 0.5, True) for j in range(1, 6)]
    df = spark.createDataFrame(edges, "src long, dst long, score double, fresh boolean")
    met = descent._meetings(df, 5).where("node = 0").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("member") <= 5).alias("own")
    ).collect()
    assert len(met) == 20 and max(r.n for r in met) < 40 and all(r.own == 5 for r in met)


def test_search_along_the_graph(spark):
    df = clouds(spark, 3000, seed=9)
    edges = graph.knn_graph(df, 10, metric="cosine", approximate=True)
    asked = df.where("id % 50 = 0").select(
        F.col("id").alias("query_id"), F.transform("embedding", lambda v: v * 0.9 + 0.02).alias("embedding")
    )
    docs = df.withColumnRenamed("id", "doc_id")
    exact = search.semantic_search(asked, docs, 5, None).withColumnRenamed("doc_id", "id")
    found = search.semantic_search(asked, docs, 5, None, graph=edges).withColumnRenamed("doc_id", "id")
    assert recall(exact, found, 5) >= 0.9
    assert search.semantic_search(asked, docs, 5, 2.0, graph=edges).isEmpty()


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>")
    got = S.neighbours(df, 5, approximate=True).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert S.neighbours(df.where("id > 9"), 5, approximate=True).collect() == []
