import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import jaccard_join
from corpusloom.llm.components import connected
from corpusloom.llm.jaccard_join import near_classes
from corpusloom.llm.shingle_sets import distinct_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + rng.choice([0, 1, 1])] = [rng.choice(["xx", "yy", "zz", "qq"]) + str(rng.randrange(999))]
    return words


def corpus(rng):
    vocab = [f"w{i}" for i in range(800)]
    line = [rng.choice(vocab) for _ in range(60)]
    rows = [None, "", "  \n", "one two", "ONE\ttwo", "two one", "a a a a a a a a", "a a a a a"]
    base = [rng.choice(vocab) for _ in range(150)]
    for k in range(60):  # a large loose group
        rows.append(" ".join(edited(rng, base, rng.randint(0, 4))))
    chain = [rng.choice(vocab) for _ in range(120)]
    for _ in range(25):  # a chain: the ends are not alike
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    for _ in range(60):  # one passage in many documents
        own = [rng.choice(vocab) for _ in range(rng.randint(20, 260))]
        at = rng.randint(0, len(own))
        rows.append(" ".join(own[:at] + line + own[at:]))
    for _ in range(40):
        own = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 4)):
            rows.append("\n".join(edited(rng, own, rng.randint(0, 3))))
    rows += [base_text for base_text in rows[10:14] * 5]
    rng.shuffle(rows)
    out = list(enumerate(rows, 100))
    return out + [(None, rows[3]), (None, "lonely row without any id or copy at all"), (out[0][0], rows[0])]


@pytest.mark.parametrize("seed,least", [(1, 16), (2, 3)])
def test_classes(spark, table, monkeypatch, seed, least):
    monkeypatch.setattr(jaccard_join, "LEAST", least)
    rows = corpus(random.Random(seed))
    df = table(rows, n="clash", node="x", grp=1).repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_classes(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_all_pairs_left(spark, table, monkeypatch, rounds):
    """Without pivot rounds the last step alone has to find every link that the first left."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rows = corpus(random.Random(3 + rounds))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_classes(table(rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [80, 60])
def test_faces_what_can_link(spark, percent):
    """A posting is shown to the band of every size it can still link with, whatever its place."""
    sizes = list(range(1, 40)) + [55, 80, 120, 200]
    rows = [(n, p) for n in sizes for p in range(1, n - (percent * n + 99) // 100 + 2)]
    df = spark.createDataFrame(rows, "n bigint, place int")
    shown = {}
    for r in jaccard_join._facing(df, percent).collect():
        shown.setdefault((r.n, r.place), set()).add((r.low, r.high))
    for n, p in rows:
        for m, q in rows:
            need = -(-percent * (n + m) // (100 + percent))
            if 100 * min(n, m) >= percent * max(n, m) and p <= n - need + 1 and q <= m - need + 1:
                assert shown[n, p] & shown[m, q], (n, p, m, q)


def test_empty(spark):
    assert near_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sets():
    texts = ["a b c d e f a b c d e", "É 日本", None, "", "A b C d E", "x " * 9]
    got = {}
    for first, h, cuts in distinct_sets(pa.array(texts), 5):
        for k in range(len(cuts) - 1):
            got[first + k] = h[cuts[k] : cuts[k + 1]]
    assert [len(got[i]) for i in range(6)] == [len(shingles(t)) for t in texts]
    assert np.isin(got[4], got[0]).all()


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 40, 300, 3000):
        for _ in range(40):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
            drop = rng.integers(0, max(1, n // 4) + 1)
            y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1)).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                assert jaccard_join._may_link(jaccard_join._sketch(x), jaccard_join._sketch(y), len(x), len(y), 80)
    x, y = (rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) for _ in range(2))
    assert not jaccard_join._may_link(jaccard_join._sketch(x), jaccard_join._sketch(y), 500, 500, 80)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(61)} == {0}
    for u, v in edges:
        assert u == v or got[u] == got[v]
    assert connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
