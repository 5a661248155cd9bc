import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.runtime import materialize


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(20, 5)) + 4 * (i % 2) for i in range(3)])
    x[5] = x[6]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)


def plain_fuzzy(x, k):
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)).round(6)
    n = len(x)
    near = [sorted(range(n), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    mean_all = np.mean([d[i, near[i]] for i in range(n)])
    w = np.zeros((n, n))
    for i in range(n):
        row = d[i, near[i]]
        rho = row[row > 0].min() if (row > 0).any() else 0.0
        low, high, mid = 0.0, np.inf, 1.0
        for _ in range(64):
            total = sum(np.exp(-(v - rho) / mid) if v > rho else 1.0 for v in row[1:])
            if abs(total - np.log2(k)) < 1e-5:
                break
            if total > np.log2(k):
                high, mid = mid, (low + mid) / 2
            else:
                low = mid
                mid = mid * 2 if high == np.inf else (mid + high) / 2
        mid = max(mid, 1e-3 * (row.mean() if rho > 0 else mean_all))
        for j, v in zip(near[i], row):
            if j != i:
                w[i, j] = 1.0 if v <= rho else np.exp(-(v - rho) / mid)
    return w + w.T - w * w.T


def test_fuzzy_weights(points):
    x, df = points
    edges = graph.fuzzy_graph(graph.knn_graph(df, 6, metric="euclidean"), 6).collect()
    want = plain_fuzzy(x, 6)
    got = np.zeros_like(want)
    for e in edges:
        assert e.src < e.dst
        got[e.src, e.dst] = got[e.dst, e.src] = e.weight
    assert np.allclose(got, want, atol=1e-6)


def test_spectral_layout_finds_the_leading_eigenvectors(points):
    x, df = points
    edges = materialize(graph.fuzzy_graph(graph.knn_graph(df, 12, metric="euclidean"), 12))
    n = len(x)
    w = np.zeros((n, n))
    for e in edges.collect():
        w[e.src, e.dst] = w[e.dst, e.src] = e.weight
    deg = w.sum(1)
    m = w / np.sqrt(np.outer(deg, deg))
    top = np.sort(np.linalg.eigvalsh(m))[::-1]
    rows = {r.id: (r.x, r.y) for r in graph.spectral_layout(edges, 2, 1e-7).collect()}
    v = np.array([rows[i] for i in range(n)])
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-7)
    for axis in (0, 1):
        value = v[:, axis] @ m @ v[:, axis]
        assert abs(value - top[axis + 1]) < 1e-9
        assert np.linalg.norm(m @ v[:, axis] - value * v[:, axis]) < 1e-6
        assert v[np.abs(v[:, axis]).argmax(), axis] > 0


def test_spectral_layout_of_parts_and_of_a_tiny_graph(spark):
    """Two parts: the first axis is constant (up to degree) on each and tells them apart."""
    ring = [(i, (i + 1) % 7, 1.0) for i in range(7)] + [(10 + i, 10 + (i + 1) % 5, 1.0) for i in range(5)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in ring], "src long, dst long, weight double")
    rows = {r.id: r.x for r in graph.spectral_layout(edges, 2).collect()}
    first, second = ([v for i, v in rows.items() if (i < 10) == small] for small in (True, False))
    assert np.ptp(first) < 1e-6 and np.ptp(second) < 1e-6 and first[0] * second[0] < 0
    pair = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    got = sorted((r.id, r.x, r.y) for r in graph.spectral_layout(pair, 2).collect())
    assert np.allclose(sorted(x for _, x, _ in got), [-(0.5**0.5), 0.5**0.5], atol=1e-6)


def test_layout_and_edge_table(points):
    x, df = points
    flat = graph.layout(df, 3)
    assert flat.columns == ["id", "x", "y", "z"] and flat.count() == len(x)
    edges = graph.fuzzy_graph(graph.knn_graph(df, 4, metric="euclidean"), 4)
    table = graph.edge_table(edges, flat)
    assert table.count() == edges.count()
    assert table.filter(F.isnull("x0") | F.isnull("y1")).count() == 0


def test_align_pad(spark):
    vectors = spark.createDataFrame([(c, i) for c in (1, 2, 3) for i in range(3)], "chapter int, idx int")
    texts = spark.createDataFrame(
        [(1, i, f"s{i}", "frodo, sam", "") for i in range(5)] + [(2, 0, "only", "", "shire")],
        "chapter int, idx int, sentence string, character string, place string",
    )
    rows = {(r.chapter, r.idx): r for r in graph.point_table(graph.align_pad(vectors, texts)).collect()}
    assert [rows[1, i].sentence for i in range(3)] == ["s0", "s1", "s2"]
    assert [rows[2, i].sentence for i in range(3)] == ["only", "Sentence 0 from Chapter 2", "Sentence 1 from Chapter 2"]
    assert [rows[3, i].sentence for i in range(3)] == [f"Sentence {i} from Chapter 3" for i in range(3)]
    assert rows[1, 0].character_label == "frodo" and rows[2, 0].character_label == "unknown" and rows[3, 1].character == "unknown"
    off = {(r.chapter, r.n_vectors, r.n_texts) for r in graph.length_mismatch(vectors, texts).collect()}
    assert off == {(1, 3, 5), (2, 3, 1), (3, 3, 0)}


def test_edges_in_three_dimensions(spark):
    edges = spark.createDataFrame([(1, 2, 0.5)], "src bigint, dst bigint, weight double")
    coords = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (2, 3.0, 4.0, 5.0)], "id bigint, x double, y double, z double")
    row = graph.edge_table(edges, coords).first()
    assert (row.x0, row.y0, row.z0, row.x1, row.y1, row.z1, row.weight) == (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.5)


def test_pca_only_above(spark):
    from corpusloom.operators import embeddings

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 5.0])], "id bigint, embedding array<float>")
    same = embeddings.pca_project(df, 1, only_above=2).orderBy("id").collect()
    assert [list(r.coords) for r in same] == [[1.0, 2.0], [0.0, 5.0]]
    assert all(len(r.coords) == 1 for r in embeddings.pca_project(df, 1, only_above=1).collect())
