"""Keyword, lexical, semantic and re-ranked retrieval for a table of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ordering import with_row_ids
from corpusloom.operators.similarity import nearest
from corpusloom.runtime import materialize, materialize_counted

_AUTOMATON_BYTES = 32 << 20  # keywords of one automaton, which every worker builds
_SENT_HITS = 1 << 20

K1, B, EPSILON = 1.5, 0.75, 0.25  # BM25 constants


# --- exact ---------------------------------------------------------------------------


def exact_match(
    queries: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    case_sensitive: bool = False,
    automaton_bytes: int = _AUTOMATON_BYTES,
) -> DataFrame:
    """Rows that contain every keyword of a query as a substring.

    ``queries(query_id, keywords)``; returns ``(query_id, id, text, keyword_positions,
    match_type)``. All keywords are looked for in one pass over each text by an automaton, so
    the work does not grow with their number. Queries whose keywords exceed ``automaton_bytes``
    together are cut into several automata, a pass each.

    An empty list matches every text, a null list or a null keyword none; a null text matches
    nothing.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.col("keywords").cast("array<string>").alias("keywords")).where(
        F.col("keywords").isNotNull() & ~F.exists("keywords", lambda k: k.isNull())
    )
    asked = materialize(
        asked.select("query_id", "keywords", F.array_distinct("keywords").alias("names")).withColumn(
            "needles", F.transform("names", fold)  # folded by the same function as the texts
        )
    )
    size = asked.agg(
        F.coalesce(F.sum(F.aggregate("needles", F.lit(0), lambda n, k: n + F.octet_length(k) + 8) + 16), F.lit(0))
    ).first()[0]
    passes = -(-size // automaton_bytes) if size else 1
    found = None
    for at in range(passes):
        part = asked.where(F.pmod(F.xxhash64("query_id", "keywords"), F.lit(passes)) == at) if passes > 1 else asked
        held = part.select("query_id", "names", "needles").toArrow()  # bounded by automaton_bytes
        named = queries.sparkSession.createDataFrame(
            held.select(["query_id", "names"]).append_column("_q", pa.array(range(len(held)), pa.int32())),
            f"query_id {kind}, names array<string>, _q int",
        )
        hits = docs.select(id_col, text, F.explode(_finder(held["needles"].to_pylist())(fold(F.col(text)))).alias("_hit"))
        rows = hits.join(F.broadcast(named), F.col("_hit.q") == F.col("_q")).select(
            "query_id",
            id_col,
            text,
            F.map_from_arrays("names", "_hit.positions").alias("keyword_positions"),
            F.lit("accurate").alias("match_type"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


_BUILT: dict[int, tuple] = {}  # the automaton this worker used last


def _finder(needles: list[list[str]]):
    """Column function: ``(q, positions)`` of every query all of whose needles a text holds."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(needles)

    name = uuid.uuid4().int

    @F.arrow_udf("array<struct<q:int,positions:array<int>>>")
    def find(texts: pa.Array) -> pa.Array:
        held = _automaton_for(name, shared)
        out = [hits_in(t, *held) for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("q", pa.int32()), ("positions", pa.list_(pa.int32()))])))

    return find.asNondeterministic()  # evaluated once


def _automaton_for(name: int, shared) -> tuple:
    """Built once by each worker process, not once a task."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton_of(shared.value)
    return _BUILT[name]


def automaton_of(needles: list[list[str]]) -> tuple:
    """Automaton over all needles, lists of needle numbers by query, queries by their anchor.

    A query is looked at only where its longest needle, the anchor, is found.
    """
    number = {k: i for i, k in enumerate(dict.fromkeys(k for row in needles for k in row))}
    automaton = ahocorasick.Automaton()
    for k, i in number.items():
        if k:
            automaton.add_word(k, (i, len(k)))
    if len(automaton):
        automaton.make_automaton()
    anchored: dict[int, list[int]] = {}
    free = []
    for q, row in enumerate(needles):
        longest = max(row, key=len, default="")
        if longest:
            anchored.setdefault(number[longest], []).append(q)
        else:
            free.append(q)
    return automaton, [[number[k] for k in row] for row in needles], anchored, free, number.get("")


def hits_in(text: str | None, automaton, wanted, anchored, free, empty) -> list[dict]:
    """Queries whose needles all occur in ``text``, with the first position of each needle."""
    if text is None:
        return []
    first: dict[int, int] = {} if empty is None else {empty: 0}
    if len(automaton):
        for end, (i, n) in automaton.iter(text):
            if i not in first:
                first[i] = end - n + 1
    hits = [{"q": q, "positions": [0] * len(wanted[q])} for q in free]
    for i in first:
        for q in anchored.get(i, ()):
            if all(k in first for k in wanted[q]):
                hits.append({"q": q, "positions": [first[k] for k in wanted[q]]})
    return hits


# --- BM25 ----------------------------------------------------------------------------


def bm25_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, df, idf)`` plus one row with a null word: ``df`` = number of documents and
    ``total_length`` = number of tokens. One pass over the documents."""
    seen = F.concat(F.array_distinct(tokens), F.array(F.lit(None).cast("string")))
    return (
        docs.select(F.size(tokens).cast("long").alias("_len"), F.explode_outer(seen).alias("word"))
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.sum(F.when(F.col("word").isNull(), F.col("_len"))).alias("total_length"),
        )
    )


def bm25_idf(stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``(word, df, idf)``; a negative idf becomes ``epsilon`` times the mean idf."""
    total = stats.filter(F.col("word").isNull()).agg(F.max("df")).scalar()
    raw = stats.filter(F.col("word").isNotNull()).select(
        "word", "df", (F.log(total - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("word", "df", F.when(F.col("raw") < 0, mean * epsilon).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(
    queries: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    stop: list[str] | None = None,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
) -> DataFrame:
    """Okapi BM25 ``(query_id, id, score)`` of every document that shares a word with a query.

    ``queries(query_id, query)``. A query word counts as often as it is repeated. Only
    occurrences of query words leave the scan of the documents.
    """
    tokenised = docs.select(id_col, X.search_tokens(F.col(text), stop).alias("tokens"))
    stats = materialize(bm25_stats(tokenised))
    corpus = stats.filter(F.col("word").isNull()).agg(
        (F.max("total_length") / F.max("df")).alias("avg_length")
    )
    asked = (
        queries.select("query_id", F.explode(X.search_tokens(F.col("query"), stop)).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    asked = materialize(asked.join(bm25_idf(stats, epsilon), "word").select("query_id", "word", "qtf", "idf"))
    postings = (
        tokenised.select(id_col, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("word"))
        .join(asked.select("word").distinct(), "word", "left_semi")
        .groupBy(id_col, "dl", "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    avg_length = corpus.scalar()
    damp = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avg_length)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(k1 + 1) / damp
    return (
        postings.join(asked, "word")
        .groupBy("query_id", id_col)
        .agg(F.round(F.sum(part), 6).alias("score"))
    )


def top_hits(scores: DataFrame, k: int, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """Best ``k`` rows of every query with their ``rank``; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    id_col: str = "doc_id",
    text: str = "text",
    keep_zero: bool = False,
    **options,
) -> DataFrame:
    """Lexical top ``k``: ``(query_id, id, score, rank)``.

    With ``keep_zero`` queries with fewer hits are filled with the first documents at score 0.
    """
    scores = bm25_scores(queries, docs, id_col, text, **options)
    if keep_zero:
        scores = materialize(scores)
        best = top_hits(scores.where(F.col("score") > 0), k, id_col).drop("rank")
        below = top_hits(scores.where(F.col("score") <= 0), k, id_col).drop("rank")
        short = queries.select("query_id").distinct().join(
            best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k), "query_id", "left_anti"
        )
        zero = _without_hit(short, scores.select("query_id", id_col), docs.select(id_col), k, id_col)
        scores = best.unionByName(below).unionByName(zero.withColumn("score", F.lit(0.0)))
    return top_hits(scores, k, id_col)


def _without_hit(queries: DataFrame, hits: DataFrame, docs: DataFrame, k: int, id_col: str) -> DataFrame:
    """The first ``k`` documents by id that are no hit of a query, found in the gaps of its hits."""
    numbered = materialize(with_row_ids(docs.distinct(), [id_col], "_no"))
    total = numbered.agg(F.count(F.lit(1))).scalar()
    ends = queries.select("query_id", F.lit(-1).cast("long").alias("_no")).unionByName(
        hits.join(queries, "query_id").join(numbered, id_col).select("query_id", "_no")
    )
    order = Window.partitionBy("query_id").orderBy("_no")
    gaps = ends.select(
        "query_id",
        (F.col("_no") + 1).alias("_from"),
        F.coalesce(F.lead("_no").over(order), total).alias("_to"),
        # hits before the gap; the row at -1 is none
        (F.col("_no") + 1 - (F.row_number().over(order) - 1)).alias("_missed"),
    ).where((F.col("_from") < F.col("_to")) & (F.col("_missed") < k))
    last = F.least(F.col("_to"), F.col("_from") + k - F.col("_missed")) - 1
    free = gaps.select("query_id", F.explode(F.sequence("_from", last)).alias("_no"))
    return free.join(numbered, "_no").select("query_id", id_col)


def first_documents(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by id: the prefix a trial run works on."""
    return docs.orderBy(id_col).limit(n)


# --- semantic ------------------------------------------------------------------------


def semantic_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    threshold: float | None = 0.5,
    id_col: str = "doc_id",
    vec: str = "embedding",
    graph: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` by cosine, then the threshold, so fewer than ``k`` rows may remain.

    ``queries(query_id, embedding)``; returns ``(query_id, id, score, rank)``. With a neighbour
    ``graph(src, dst)`` of the documents the search is approximate.
    """
    hits = nearest(queries, docs, k, "query_id", "embedding", id_col, vec, graph=graph)
    hits = hits.withColumnRenamed("id", id_col)
    return hits if threshold is None else hits.filter(F.col("score") >= threshold)


def query_text(keywords: Column) -> Column:
    """Keywords joined into one query string."""
    return F.array_join(keywords, " ")


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    encode: Callable[[DataFrame, str], DataFrame],
    id_col: str = "doc_id",
    text: str = "text",
    k: int = 5,
    threshold: float = 0.5,
    case_sensitive: bool = False,
    fallback_to_semantic: bool = True,
) -> DataFrame:
    """Exact rows for the queries that have any, semantic rows for the others.

    ``queries(query_id, keywords)``. ``encode(df, text_column)`` adds an ``embedding`` column;
    documents that already carry one are not encoded again.
    """
    exact = materialize(exact_match(queries, docs, id_col, text, case_sensitive))
    exact = exact.select(
        "query_id",
        id_col,
        text,
        "match_type",
        F.lit(None).cast("double").alias("similarity"),
        "keyword_positions",
        F.lit(None).cast("array<string>").alias("keywords_contained"),
    )
    if not fallback_to_semantic:
        return exact
    open_queries = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    asked = encode(open_queries.withColumn("_query", query_text(F.col("keywords"))), "_query")
    encoded = docs if "embedding" in docs.columns else encode(docs, text)
    hits, found = _texts_of(semantic_search(asked, encoded, k, threshold, id_col), docs, id_col, text)
    semantic = (
        hits.join(open_queries, "query_id")
        .join(found, id_col)
        .select(
            "query_id",
            id_col,
            text,
            F.lit("semantic").alias("match_type"),
            F.col("score").alias("similarity"),
            F.lit(None).cast("map<string,int>").alias("keyword_positions"),
            X.contained_keywords(F.col(text), F.col("keywords")).alias("keywords_contained"),
        )
    )
    return exact.unionByName(semantic)


# --- re-ranking ----------------------------------------------------------------------


def term_coverage(query: Column, passage: Column) -> Column:
    """Share of the distinct query words that occur in the passage."""
    asked = F.array_distinct(X.search_tokens(query))
    found = F.array_intersect(asked, X.search_tokens(passage))
    return F.when(F.size(asked) > 0, F.size(found) / F.size(asked)).otherwise(F.lit(0.0))


def attach_text(hits: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Look up the passage of every hit, on one line."""
    hits, found = _texts_of(hits, docs, id_col, text)
    return hits.join(found.select(id_col, X.one_line(F.col(text)).alias("passage")), id_col)


def _texts_of(hits: DataFrame, docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The hits, written and counted, and the documents they name; no other text moves.

    Up to ``_SENT_HITS`` ids are sent to the scan (8 bytes each), more are joined.
    """
    hits, n = materialize_counted(hits)
    ids = hits.select(id_col).distinct()
    needed = docs.select(id_col, text).join(F.broadcast(ids) if n <= _SENT_HITS else ids, id_col, "left_semi")
    return hits, needed


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    k: int = 3,
    scorer: Callable = term_coverage,
    batch_scorer: Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Score (query, passage) pairs of the hits again and keep the best ``k`` per query.

    ``scorer`` builds a column from the two texts. ``batch_scorer`` takes Arrow batches of the
    two texts instead, for an external model.
    """
    hits, found = _texts_of(hits.drop("rank"), docs, id_col, text)
    paired = hits.join(queries.select("query_id", "query"), "query_id").join(found, id_col)
    if batch_scorer is not None:

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from batch_scorer(batches)

        run.__annotations__ = {
            "batches": Iterator[tuple[pd.Series, pd.Series]],
            "return": Iterator[pd.Series],
        }
        score = F.pandas_udf(run, "double")("query", text)
    else:
        score = scorer(F.col("query"), F.col(text))
    scored = paired.withColumn("cross_score", F.round(score, 6)).drop("query", text)
    return top_hits(scored, k, id_col, "cross_score")


def search_report(
    queries: DataFrame,
    docs: DataFrame,
    retrieved: int = 32,
    shown: int = 3,
    id_col: str = "doc_id",
    text: str = "text",
    scorer: Callable = term_coverage,
) -> DataFrame:
    """Lexical, vector and re-ranked top hits side by side: ``(stage, query_id, id, score, rank)``.

    ``queries(query_id, query, embedding)``, ``docs(id, text, embedding)``.
    """
    lexical = bm25_search(queries, docs, shown, id_col, text, keep_zero=True)
    hits = materialize(semantic_search(queries, docs, retrieved, None, id_col))
    again = rerank(hits, queries, docs, shown, scorer, None, id_col, text).select(
        "query_id", id_col, F.col("cross_score").alias("score"), "rank"
    )
    columns = ["stage", "query_id", id_col, "score", "rank"]
    return (
        lexical.withColumn("stage", F.lit("lexical")).select(columns)
        .unionByName(hits.filter(F.col("rank") <= shown).withColumn("stage", F.lit("vector")).select(columns))
        .unionByName(again.withColumn("stage", F.lit("reranked")).select(columns))
    )
