import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.raw_words import clean_codes
from corpusloom.functions.stopwords import stop_words
from corpusloom.operators import corpus, word_pairs

TEXTS = [
    "I cannot, we're gonna! don't Lemme wannabe", "Ünïcode ﬁnd the Ⅻ ℝeal space line\u0085next", None, "", " \t\n",
    "a\x1cb c\x00d EİFK ΣΣ x¨y CAN­NOT cànnot", "12 34 .. ?!", "\U0001f130\U0001f190 ﷺ tail ",
    "the of and", " one two　three​four",
]


def in_tasks(texts):
    codes, words, sizes = clean_codes(pa.array(texts, pa.string()), list(stop_words("english")))
    tokens = iter([words[int(c)].as_py() for c in codes])
    return [[next(tokens) for _ in range(n)] for n in sizes]


def test_words_are_those_of_the_column_function(spark):
    every = [f"a{chr(c)}b {chr(c)}" for c in [*range(0x3100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]]
    texts = TEXTS + [" ".join(every[i : i + 500]) for i in range(0, len(every), 500)] + every[:400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {r.i: r.w or [] for r in df.select("i", X.clean_tokens(F.col("t")).alias("w")).collect()}
    got = in_tasks(texts)
    assert [i for i in want if got[i] != want[i]] == []


def test_no_texts():
    assert in_tasks([]) == [] and in_tasks([None]) == [[]]


def test_texts_and_their_tokens_count_the_same_pairs(spark):
    rows = [(i, " ".join(TEXTS[j] or "" for j in range(len(TEXTS)) if (i >> j) & 1) or None) for i in range(0, 1024, 9)]
    df = spark.createDataFrame(rows, "doc_id long, t string").repartition(3)
    tokens = df.select("doc_id", X.clean_tokens(F.col("t")).alias("tokens"))
    for order in (None, ["doc_id"]):
        want, got = (sorted(map(tuple, corpus.pmi(x, c, order=order).collect())) for x, c in ((tokens, "tokens"), (df, "t")))
        assert want == got and want


def test_tokens_are_numbered_once_and_words_travel_in_lists(spark):
    """No row a word or a token: blocks go to the counts, lists of words to their sums."""
    df = spark.createDataFrame([(i, "red green blue " * 9) for i in range(40)], "doc_id long, t string").repartition(4)
    blocks = word_pairs.number_tokens(df, "t", 9, ["doc_id"])
    rows = blocks.collect()
    assert len(rows) == 40 and sum(r["_block"] is not None for r in rows) <= 4
    assert sum(r["_block"].n for r in rows if r["_block"]) == 40 * 27
    assert all(r["_head"] == r["_tail"] == ["red", "green", "blue"] * 3 for r in rows)
    plan = word_pairs._able_words(blocks, None, "_block", 9, 10, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_pairs_of_words_off_the_list_are_scored(spark, monkeypatch):
    rows = [(i, f"alpha beta w{'abcdefg'[i % 7]} gamma") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, t string").repartition(3)
    want = sorted(map(tuple, corpus.pmi(df, "t").collect()))
    for listed in (0, 3):
        monkeypatch.setattr(word_pairs, "_LIST_WORDS", listed)
        assert sorted(map(tuple, corpus.pmi(df, "t").collect())) == want and want
