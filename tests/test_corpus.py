import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, ordering


def stream(seed, n=200):
    rng = random.Random(seed)
    return [(i * 3, [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 30]))]) for i in range(n)]


def frame(spark, docs, parts):
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("window", [2, 10])
def test_stream_window_crosses_rows(spark, parts, window, monkeypatch):
    monkeypatch.setattr(corpus, "_STRETCH", 16)
    docs = stream(parts)
    got = {(r.word1, r.word2): r.n_pair for r in corpus.cooccurrence_stream(frame(spark, docs, parts), ["doc_id"], window=window).collect()}
    flat = [t for _, d in docs for t in d]
    want = Counter((flat[i], flat[j]) for i in range(len(flat)) for j in range(i + 1, min(i + window, len(flat))))
    assert got == dict(want)


def test_pmi_against_plain_python(spark):
    docs = stream(3)
    got = {(r.word1, r.word2): (r.n_pair, r.mi_score) for r in corpus.pmi(frame(spark, docs, 3), order=["doc_id"]).collect()}
    flat = [t for _, d in docs for t in d]
    words = Counter(flat)
    pairs = Counter((flat[i], flat[j]) for i in range(len(flat)) for j in range(i + 1, min(i + 10, len(flat))))
    want = {p: n for p, n in pairs.items() if n >= 10}
    assert set(got) == set(want)
    for (a, b), n in want.items():
        score = math.log2(n / 9 * len(flat)) - math.log2(words[a] * words[b])
        assert got[a, b][0] == n and abs(got[a, b][1] - score) < 1e-9


def test_term_frequency_order(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["c", "a"],), ([],), (None,)], "tokens array<string>")
    assert [tuple(r) for r in corpus.term_frequency(df).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_row_ids_and_running_totals(spark):
    rows = [(i % 2, i, i % 5) for i in range(500)]  # the leading order column has two hot values
    df = spark.createDataFrame(rows, "g int, i int, w int").repartition(7)
    ordered = sorted(rows)
    got = ordering.with_row_ids(df, ["g", "i"]).orderBy("row_id").collect()
    assert [(r.g, r.i, r.row_id) for r in got] == [(g, i, n) for n, (g, i, _) in enumerate(ordered)]
    totals = {(r.g, r.i): r.t for r in ordering.with_running_total(df, ["g", "i"], "w", "t").collect()}
    before = 0
    for g, i, w in ordered:
        assert totals[g, i] == before
        before += w
    inside = {(r.g, r.i): r.idx for r in ordering.index_in_group(df, "g", ["i"]).collect()}
    assert all(inside[g, i] == i // 2 for g, i, _ in rows)


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z"), (3, "b")], "pos int, label string")
    got = {r.label: r.code for r in ordering.factorize(df, "label", "pos").collect()}
    assert got == {"z": 0, "a": 1, "b": 2}


def test_token_expression_runs_once(spark):
    """No size filter on the token expression below the generators."""
    from corpusloom.functions import text as X

    df = spark.createDataFrame([("a b",)], "text string").select(X.clean_tokens(F.col("text")).alias("tokens"))
    plan = corpus.cooccurrence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
