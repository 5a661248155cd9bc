import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import embeddings as E
from corpusloom.operators import similarity as S


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8)) * 3
    x = np.vstack([c + rng.normal(size=(60, 8)) * 0.4 for c in centers])
    x[:120] = x[0]  # a third of all rows are copies
    x[200] = 0.0
    return x, rng.integers(0, 3, len(x))


def frame(spark, data):
    x, g = data
    rows = [(i, [float(v) for v in x[i]], int(g[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, embedding array<double>, grp int").repartition(5)


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def expected(scores, k):
    out = {}
    for i, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))
        out.update({(i, r + 1): (int(j), row[j]) for r, j in enumerate(order[:k]) if row[j] > -8e8})
    return out


@pytest.fixture(params=[False, True], ids=["one cell", "many cells"])
def small_blocks(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(S, "_BLOCK_ROWS", 16)


def check(hits, want):
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in hits.collect()}
    assert set(got) == set(want)
    for key, (i, s) in want.items():
        assert got[key][0] == i and abs(got[key][1] - s) < 2e-6


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("grouped", [False, True])
def test_neighbours(spark, data, small_blocks, metric, grouped):
    x, g = data
    if metric == "cosine":
        scores = np.round(unit(x) @ unit(x).T, 6)
    else:
        scores = np.round(-np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    if grouped:
        scores[g[:, None] != g[None]] = -1e9
    hits = S.neighbours(frame(spark, data), 7, metric=metric, group="grp" if grouped else None)
    check(hits, expected(scores, 7))


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "blocks"])
def test_nearest(spark, data, small_blocks, limit):
    x, _ = data
    df = frame(spark, data)
    q = df.filter("id >= 300").withColumnRenamed("id", "query_id")
    scores = np.round(unit(x[300:]) @ unit(x).T, 6)
    want = {(i + 300, r): v for (i, r), v in expected(scores, 5).items()}
    check(S.nearest(q, df, 5, broadcast_bytes=limit), want)


def test_similar_pairs(spark, data, small_blocks):
    x, g = data
    scores = np.round(unit(x) @ unit(x).T, 6)
    got = {(r.a, r.b) for r in S.similar_pairs(frame(spark, data), 0.95, group="grp").collect()}
    n = len(x)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if g[i] == g[j] and scores[i, j] >= 0.95}


def test_centrality(spark, data):
    x, g = data
    got = {r.id: r.avg_similarity for r in E.mean_similarity(frame(spark, data), "grp").collect()}
    u = unit(x)
    for label in range(3):
        rows = np.flatnonzero(g == label)
        means = (u[rows] @ u[rows].T).mean(1)
        assert all(abs(got[i] - m) < 1e-9 for i, m in zip(rows, means))


def test_cosine_and_parse(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    texts = ["[1.0, 2.5]", "[1.0 2.5]", " [ 1e-3   2 ] ", "[1.0, x]", "nope", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", V.parse(F.col("t")).alias("v")).collect()}
    assert got == {0: [1.0, 2.5], 1: [1.0, 2.5], 2: [0.001, 2.0], 3: None, 4: None, 5: None, 6: None}


def test_pca_per_group(spark, data):
    x, g = data
    got = {r.id: r.coords for r in E.pca_project(frame(spark, data), 3, group="grp").collect()}
    for label in range(3):
        rows = np.flatnonzero(g == label)
        c = x[rows] - x[rows].mean(0)
        _, vectors = np.linalg.eigh(c.T @ c)
        top = vectors[:, ::-1][:, :3].T
        top = top * np.sign(top[np.arange(3), np.abs(top).argmax(1)])[:, None]
        assert np.allclose(np.array([got[i] for i in rows]), c @ top.T, atol=1e-6)


def test_evaluation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(80, 4)), rng.normal(size=(80, 4))
    label = rng.choice([0.8, 0.4, 0.2, 0.1], 80)
    df = spark.createDataFrame(
        [(list(map(float, p)), list(map(float, q)), float(s)) for p, q, s in zip(a, b, label)],
        "vec_a array<double>, vec_b array<double>, label double",
    )
    import pandas as pd

    cos = pd.Series(np.round((unit(a) * unit(b)).sum(1), 6))
    got = E.evaluate_encoder(df).first()
    assert got.n_pairs == 80
    assert abs(got.pearson - cos.corr(pd.Series(label))) < 1e-9
    assert abs(got.spearman - cos.rank().corr(pd.Series(label).rank())) < 1e-9


def test_encoders(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "a bb", ["a", "bb"]), (2, None, ["a"])], "id int, t string, tokens array<string>")

    def lengths(batches):
        for batch in batches:
            yield pd.Series([[float(len(t)), 1.0] for t in batch])

    got = {r.id: r.embedding for r in E.embed_text(df, "t", lengths).collect()}
    assert got == {1: [4.0, 1.0], 2: [0.0, 1.0]}
    native = {r.id: r.embedding for r in E.embed_text(df, "t", E.letter_profile, native=True).collect()}
    assert native[1][:2] == [1.0, 2.0]
    fitted = E.embed_text(df, "t", fallback=E.fit_tfidf(df, size=16))
    assert all(len(r.embedding) == 16 for r in fitted.collect())
    trained = E.embed_text(df, "t")
    assert all(len(r.embedding) == 64 for r in trained.collect())


def test_blocks_travel_once_a_set(spark, monkeypatch):
    """Every block pair is scored, but the blocks are not sent once for each pair."""
    monkeypatch.setattr(S, "_BLOCK_ROWS", 16)
    x = np.random.default_rng(5).normal(size=(1200, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    rows = S._prepared(df, "id", "embedding", "cosine", None)
    pivots = S._pivots(rows)
    blocks = S._blocks(rows, pivots, "cosine")
    pairs = S._block_pairs(blocks, blocks, pivots, "cosine")
    sent = S._tiles(pairs, blocks, blocks).select("later", F.size("lefts").alias("n")).toPandas()
    assert sent["n"].sum() == pairs.count() > 5000
    assert len(sent) < pairs.count() / 4
    check(S.neighbours(df, 7), expected(np.round(unit(x) @ unit(x).T, 6), 7))
