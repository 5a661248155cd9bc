import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search

DOCS = [
    (0, "The ring was forged in fire. Rings of power!"),
    (1, "Frodo carried the ring to the mountain"),
    (2, "mountain fire"),
    (3, ""),
    (4, "Frodo, Frodo and frodo again with fire"),
    (5, "frodo carried the ring to the mountain"),
    (6, "unrelated words only"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def keyword_queries(spark):
    rows = [(0, ["Frodo", "RING"]), (1, ["fire"]), (2, []), (3, ["nowhere", "fire"]), (4, ["o", "f"]), (5, ["Frodo", "Frodo"])]
    return spark.createDataFrame(rows, "query_id long, keywords array<string>")


@pytest.mark.parametrize("case_sensitive", [False, True])
@pytest.mark.parametrize("limit", [1 << 20, 60], ids=["one automaton", "several"])
def test_exact_match(docs, keyword_queries, case_sensitive, limit):
    hits = search.exact_match(keyword_queries, docs, case_sensitive=case_sensitive, automaton_bytes=limit).collect()
    fold = (lambda s: s) if case_sensitive else str.lower
    want = {}
    for q in keyword_queries.collect():
        for i, t in DOCS:
            if all(fold(k) in fold(t) for k in q.keywords):
                want[q.query_id, i] = {k: fold(t).find(fold(k)) for k in q.keywords}
    assert len(hits) == len(want)
    assert {(h.query_id, h.doc_id): h.keyword_positions for h in hits} == want
    assert {h.match_type for h in hits} == {"accurate"}


def bm25(query, stop):
    import string

    def tokens(t):
        return [w for w in (p.strip(string.punctuation) for p in t.lower().split()) if w and w not in stop]

    corpus = [tokens(t) for _, t in DOCS]
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(w for d in corpus for w in set(d))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for d in corpus:
        tf = Counter(d)
        out.append(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in tokens(query)))
    return out


def test_bm25_with_repeated_words_and_zero_rows(spark, docs):
    stop = ["the", "in", "of", "to", "and", "was", "with"]
    queries = spark.createDataFrame([(0, "Frodo frodo fire"), (1, "the of"), (2, "ring mountain")], "query_id long, query string")
    got = search.bm25_search(queries, docs, 5, keep_zero=True, stop=stop).collect()
    for q in queries.collect():
        scores = [round(s, 6) for s in bm25(q["query"], stop)]
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:5]
        rows = sorted((r for r in got if r.query_id == q.query_id), key=lambda r: r["rank"])
        assert [r.doc_id for r in rows] == order
        assert all(abs(r.score - scores[r.doc_id]) < 2e-6 for r in rows)
    assert search.bm25_search(queries, docs, 5, stop=stop).filter("query_id = 1").count() == 0


def counts(df, column):
    return df.withColumn("embedding", F.array(*[F.length(F.regexp_replace(F.lower(F.col(column)), f"[^{c}]", "")).cast("double") for c in "frn"]))


def test_retrieve_prefers_exact_rows(docs, keyword_queries):
    hits = search.retrieve(keyword_queries, docs, counts, k=2, threshold=0.5).collect()
    kinds = {}
    for h in hits:
        kinds.setdefault(h.query_id, set()).add(h.match_type)
    assert kinds == {0: {"accurate"}, 1: {"accurate"}, 2: {"accurate"}, 3: {"semantic"}, 4: {"accurate"}, 5: {"accurate"}}
    semantic = [h for h in hits if h.match_type == "semantic"]
    assert 0 < len(semantic) <= 2 and all(h.similarity >= 0.5 for h in semantic)
    assert all(h.keywords_contained == [k for k in ["nowhere", "fire"] if k in h.text.lower()] for h in semantic)
    only = search.retrieve(keyword_queries, docs, counts, fallback_to_semantic=False)
    assert only.filter("query_id = 3").count() == 0


def test_threshold_applies_after_the_top_k(docs, spark):
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    encoded = counts(docs, "text")
    assert search.semantic_search(queries, encoded, 4, None).count() == 4
    assert search.semantic_search(queries, encoded, 4, 0.9).count() < 4


def test_rerank_with_a_batch_scorer(spark, docs):
    queries = spark.createDataFrame([(0, "frodo")], "query_id long, query string")
    hits = spark.createDataFrame([(0, 0, 0.9, 1), (0, 1, 0.8, 2), (0, 4, 0.7, 3)], "query_id long, doc_id long, score double, rank int")

    def count_query(batches):
        for query, passage in batches:
            yield pd.Series([float(p.lower().count(q)) for q, p in zip(query, passage)])

    best = search.rerank(hits, queries, docs, 2, batch_scorer=count_query).orderBy("rank").collect()
    assert [(r.doc_id, r.cross_score) for r in best] == [(4, 3.0), (1, 1.0)]
    native = search.rerank(hits, queries, docs, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.cross_score) for r in native] == [(1, 1.0), (4, 1.0), (0, 0.0)]


def test_report_has_three_stages(spark, docs):
    queries = counts(spark.createDataFrame([(0, "frodo ring")], "query_id long, query string"), "query")
    rows = search.search_report(queries, counts(docs, "text"), 5, 3).collect()
    assert Counter(r.stage for r in rows) == {"lexical": 3, "vector": 3, "reranked": 3}


def test_negative_scores_stay_below_documents_without_hits(spark):
    """A word that most documents hold has a negative weight; its hits are never fillers."""
    texts = ["common rare one", "other", "common", "common", "common x", "common y", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "common"), (2, "nothing here"), (3, "other"), (4, "common plain")], "query_id bigint, query string")
    everything = search.bm25_scores(queries, docs, stop=[]).collect()
    scores = {(r.query_id, r.doc_id): r.score for r in everything}
    for k in (1, 3, 5, 20):
        got = search.bm25_search(queries, docs, k, keep_zero=True, stop=[]).collect()
        for q in (1, 2, 3, 4):
            want = sorted(((-scores.get((q, d), 0.0), d) for d in range(len(texts))))[:k]
            have = sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == q)
            assert [(d, s) for _, d, s in have] == [(d, -s) for s, d in want]


def test_keywords_with_nulls_and_other_letters(spark):
    texts = ["Anna met BOB", "bob", None, "", "İstanbul and Anna", "anna"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lists = [["Anna"], ["anna", "bob"], None, [], ["Anna", None], ["İstanbul"], ["bob", "bob"], ["", "bob"]]
    queries = spark.createDataFrame(list(enumerate(lists)), "query_id bigint, keywords array<string>")
    for automaton_bytes in (1 << 20, 60):
        loose, strict = (
            sorted((r.query_id, r.doc_id) for r in search.exact_match(queries, docs, case_sensitive=c, automaton_bytes=automaton_bytes).collect())
            for c in (False, True)
        )
        every = [(3, 0), (3, 1), (3, 3), (3, 4), (3, 5)]
        assert loose == sorted([(0, 0), (0, 4), (0, 5), (1, 0), *every, (5, 4), (6, 0), (6, 1), (7, 0), (7, 1)])
        assert strict == sorted([(0, 0), (0, 4), *every, (5, 4), (6, 1), (7, 1)])
    assert search.exact_match(queries.limit(0), docs).collect() == []
    assert search.exact_match(queries, docs.limit(0)).collect() == []


def test_automaton_against_plain_search():
    """Keywords inside one another, overlapping, at the ends, and outside the basic plane."""
    import random

    draw = random.Random(1)
    letters = "abé𝒳"
    needles = [["".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 3))] for _ in range(60)]
    held = search.automaton_of(needles)
    for _ in range(40):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        got = {h["q"]: h["positions"] for h in search.hits_in(text, *held)}
        want = {q: [text.find(k) for k in row] for q, row in enumerate(needles) if all(k in text for k in row)}
        assert got == want


def test_first_documents(spark):
    docs = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "doc_id bigint, text string")
    assert [r.doc_id for r in search.first_documents(docs, 2).collect()] == [1, 2]
