import random

import pytest

from corpusloom.operators import hierarchy as H
from corpusloom.operators import network as N
from corpusloom.runtime import materialize


def upgma(words, dist, method="average"):
    clusters = {w: [w] for w in words}
    out = []
    combine = {"average": lambda d: sum(d) / len(d), "complete": max, "single": min}[method]

    def gap(a, b):
        return round(combine([dist[min(x, y), max(x, y)] for x in a for y in b]), 12)

    while len(clusters) > 1:
        names = sorted(clusters)
        d, a, b = min((gap(clusters[a], clusters[b]), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
        out.append((a, b, d, len(clusters[a]) + len(clusters[b])))
        clusters[a] = clusters[a] + clusters.pop(b)
    return out


def network(seed, n, density, low):
    rng = random.Random(seed)
    words = [f"w{i:02d}" for i in range(n)]
    rows = [
        (words[i], words[j], rng.random() * (1 - low) + low)
        for i in range(n)
        for j in range(i, n)
        if rng.random() < density or j == i + 1
    ]
    return words, rows


def dense_distances(words, rows):
    n = len(words)
    cells = [r[2] for r in rows] + ([0.0] if 2 * sum(a != b for a, b, _ in rows) + sum(a == b for a, b, _ in rows) < n * n else [])
    low, high = min(cells), max(cells)
    known = {(a, b): 1 - (s - low) / (high - low) for a, b, s in rows}
    absent = 1 - (0 - low) / (high - low)
    return {(a, b): known.get((a, b), absent) for i, a in enumerate(words) for b in words[i + 1 :]}, absent


def grow(spark, rows, method="average"):
    matrix = materialize(N.association_matrix(spark.createDataFrame(rows, "word1 string, word2 string, mi_score double")))
    absent = N.absent_distance(matrix).first()["absent"]
    return H.average_linkage(N.to_distance(matrix), absent, N.matrix_words(matrix), method), absent


@pytest.mark.parametrize("method", ["average", "complete", "single"])
@pytest.mark.parametrize("seed,density,low", [(0, 1.0, 0.0), (1, 0.2, 0.0), (2, 0.2, -0.6), (3, 0.5, -1.5)])
def test_same_tree_as_one_merge_at_a_time(spark, seed, density, low, method):
    words, rows = network(seed, 16, density, low)
    merges, absent = grow(spark, rows, method)
    got = merges.orderBy("step").collect()
    dist, d0 = dense_distances(words, rows)
    assert abs(absent - d0) < 1e-12
    want = upgma(words, dist, method)
    below = sorted((a, b, round(h, 9), s) for a, b, h, s in want if h < d0 - 1e-9)
    assert sorted((r.left, r.right, round(r.height, 9), r.size) for r in got if r.height < d0 - 1e-9) == below
    assert [round(r.height, 9) for r in got] == sorted(round(h, 9) for _, _, h, _ in want)
    assert [r.step for r in got] == list(range(1, len(words)))
    assert got[-1].size == len(words)


@pytest.mark.parametrize("method", ["average", "complete", "single"])
def test_ties_and_self_only_words(spark, method):
    """Few different scores, so nearly everything is tied; the rule by name decides."""
    rng = random.Random(4)
    words = [f"w{i:02d}" for i in range(14)]
    rows = [
        (a, b, rng.choice([-1.0, -1.0, 1.0, 2.0]))
        for i, a in enumerate(words) for b in words[i:] if a == b == "w03" or (rng.random() < 0.35 and "w03" not in (a, b))
    ]
    rows += [("w00", "w00", 2.0), ("w05", "w05", -1.0)]
    merges, absent = grow(spark, rows, method)
    dist, d0 = dense_distances(words, [*{(a, b): (a, b, s) for a, b, s in rows}.values()])
    want = upgma(words, dist, method)
    got = merges.orderBy("step").collect()
    assert len(got) == len(words) - 1 and got[-1]["size"] == len(words)
    if method == "single":  # cuts of single linkage do not depend on the order of ties
        assert [round(r.height, 9) for r in got] == sorted(round(h, 9) for _, _, h, _ in want)
    # whatever the order of ties: every merge is at the distance of its two parts
    parts = {w: [w] for w in words}
    combine = {"average": lambda d: sum(d) / len(d), "complete": max, "single": min}[method]
    for r in sorted(got, key=lambda r: r["round"]):
        a, b = parts[r.left], parts.pop(r.right)
        assert abs(r.height - combine([dist[min(x, y), max(x, y)] for x in a for y in b])) < 1e-9
        parts[r.left] = a + b


def test_spanning_forest(spark):
    rng = random.Random(8)
    edges = [(f"n{i:02d}", f"n{j:02d}", rng.choice([0.1, 0.2, 0.3])) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.1]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    want = set()
    for d, a, b in sorted((d, a, b) for a, b, d in edges):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b, d))
    df = spark.createDataFrame(edges, "a string, b string, distance double").repartition(4)
    assert {tuple(r) for r in H.spanning_forest(df).collect()} == want
    assert H.spanning_forest(df.limit(0)).collect() == []


def test_first_independent_set(spark):
    rng = random.Random(3)
    names = [f"c{i:02d}" for i in range(25)]
    far = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.15]
    want = []
    for c in names:
        if not any((w, c) in far for w in want):
            want.append(c)
    clusters = spark.createDataFrame([(c,) for c in names], "id string")
    got = H._first_independent(clusters, spark.createDataFrame(far, "a string, b string")).collect()
    assert sorted(r.id for r in got) == want


@pytest.fixture(scope="module")
def tree(spark):
    words, rows = network(5, 14, 0.4, 0.0)
    merges, _ = grow(spark, rows)
    return words, materialize(merges)


def flat(merges, words, steps):
    label = {w: w for w in words}
    for m in steps:
        for w, c in label.items():
            if c == m.right:
                label[w] = m.left
    return label


def test_cuts(spark, tree):
    words, merges = tree
    rows = merges.orderBy("step").collect()
    height = rows[6].height
    want = flat(merges, words, [r for r in rows if r.height <= height])
    assert {r.word: r.cluster for r in H.cut_by_distance(merges, height).collect()} == want
    for k in (1, 3, 5, 14, 20):
        labels = {r.word: r.cluster for r in H.cut_by_count(merges, k).collect()}
        assert len(set(labels.values())) <= k and set(labels) == set(words)
    # the tree view cuts at the (k-1)st largest height and so shows at most k-1 clusters
    cut = H.cut_by_distance(merges, H.count_threshold(merges, 5))
    assert H.cluster_count(cut).first()[0] <= 4


def test_sizes_and_shares(spark, tree):
    words, merges = tree
    labels = materialize(H.cut_by_count(merges, 4))
    sizes = {r.cluster: r["size"] for r in H.cluster_sizes(labels).collect()}
    assert sum(sizes.values()) == len(words)
    shown = H.sample_clusters(labels, 5).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in shown} == {c: max(1, round(5 * s / len(words))) for c, s in sizes.items()}
    assert H.sample_clusters(labels, 100).count() == len(words)


def test_tree_tables(spark, tree):
    words, merges = tree
    nodes = {r.node: r for r in H.tree_nodes(merges).collect()}
    assert len(nodes) == 2 * len(words) - 1
    root = [r for r in nodes.values() if r.parent is None]
    assert len(root) == 1 and root[0].level == 0 and root[0].leaves == len(words)
    for r in nodes.values():
        if r.label is None:
            kids = nodes[r.left_node], nodes[r.right_node]
            assert all(k.parent == r.node and k.level == r.level + 1 for k in kids)
            assert r.leaves == sum(k.leaves for k in kids) and r.subtree == 1 + sum(k.subtree for k in kids)
    leaves = H.truncated_tree(merges, 5).collect()
    assert len(leaves) == 5 and sum(r.leaves for r in leaves) == len(words)


def test_unconnected_words_chain_at_the_constant_distance(spark):
    rows = [("a", "b", 1.0), ("c", "d", 0.5), ("e", "f", 0.25), ("g", "g", 0.1), ("g", "h", 0.2)]
    merges, absent = grow(spark, rows)
    got = merges.orderBy("step").collect()
    assert len(got) == 7 and [r["size"] for r in got][-1] == 8
    assert all(abs(r.height - absent) < 1e-9 for r in got[4:])
    nodes = H.tree_nodes(materialize(merges)).collect()
    assert len(nodes) == 15 and sum(r.parent is None for r in nodes) == 1


def test_many_words_farther_than_the_constant(spark):
    """Few pairs beyond the constant distance among many words: most merge at the constant."""
    words = [f"w{i:02d}" for i in range(60)]
    rows = [(words[i], words[i + 1], -0.5) for i in range(59)] + [(words[0], words[0], 1.0)]
    merges, absent = grow(spark, rows)
    got = merges.collect()
    assert len(got) == 59 and max(r["size"] for r in got) == 60
    assert sum(r.height <= absent + 1e-9 for r in got) >= 40


def test_matrix_keeps_the_lower_score_and_self_pairs(spark):
    rows = [("b", "a", 3.0), ("a", "b", 1.0), ("a", "a", 5.0), ("b", "c", 2.0)]
    df = spark.createDataFrame(rows, "word1 string, word2 string, mi_score double")
    matrix = N.association_matrix(df)
    assert {(r.a, r.b): r.mi for r in matrix.collect()} == {("a", "b"): 1.0, ("a", "a"): 5.0, ("b", "c"): 2.0}
    assert {(r.a, r.b): r.distance for r in N.to_distance(matrix).collect()} == {("a", "b"): 0.8, ("b", "c"): 0.6}
    assert {r.word: r.strength for r in N.word_strength(df).collect()} == {"a": 14.0, "b": 6.0, "c": 2.0}
    assert {(r.word1, r.word2) for r in N.prune_network(df, 2).collect()} == {("b", "a"), ("a", "b"), ("a", "a")}


def test_no_scaling_without_a_positive_score(spark):
    df = spark.createDataFrame([("a", "b", -1.0)], "word1 string, word2 string, mi_score double")
    matrix = N.association_matrix(df)
    assert N.to_distance(matrix).first().distance == 2.0
    assert N.absent_distance(matrix).first().absent == 1.0


def test_words_that_only_occur_with_themselves(spark):
    rows = [("a", "b", 0.9), ("c", "c", 0.5), ("d", "d", 0.1)]
    matrix = materialize(N.association_matrix(spark.createDataFrame(rows, "word1 string, word2 string, mi_score double")))
    absent = N.absent_distance(matrix).first()
    assert absent.n_words == 4
    merges = H.average_linkage(N.to_distance(matrix), absent.absent, N.matrix_words(matrix)).collect()
    assert len(merges) == 3 and merges[0].left == "a" and merges[0].right == "b"
    assert max(m.size for m in merges) == 4


def test_one_word(spark):
    matrix = spark.createDataFrame([("c", "c", 0.5)], "a string, b string, mi double")
    merges = H.average_linkage(N.to_distance(matrix), 1.0, N.matrix_words(matrix))
    assert merges.count() == 0 and merges.columns[:3] == ["step", "left", "right"]


def test_long_word_lists(spark, monkeypatch):
    rows = [(f"w{i}", f"w{i + 1}", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "word1 string, word2 string, mi_score double")
    want = sorted(r.word for r in N.strongest_words(df, 7).collect())
    monkeypatch.setattr(N, "_BROADCAST_WORDS", 3)
    assert sorted(r.word for r in N.strongest_words(df, 7).collect()) == want
    assert N.prune_network(df, 10**9).count() == 30
