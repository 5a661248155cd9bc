import unicodedata

import regex
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.folding import fold_rules
from corpusloom.functions.stopwords import LANGUAGE_OF_CODE, spark_stop_words, stop_words


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return df.select(expr(F.col("t")).alias("r")).first().r


def plain_clean(s):
    s = regex.sub(r"\p{P}+", "", s.lower())
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return regex.sub(r"\s+", " ", regex.sub(r"[^a-zA-Z\s]", "", s)).strip()


def test_clean_text_follows_the_rules(spark):
    tricky = [
        "Café — naïve?", "™ and ﬁne ﬀ ½ ㎏ 𝐀𝐁", "a b c　d", "don't STOP… me", "İstanbul ß ĳ Ǆ",
        "", "   ", "x\x1cy\x85z", "ﷺ 🄫 ₨ № ª º", "snake_case 1st 2nd", "Été", "‗‾ ¨ ´",
    ]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(tricky)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    assert got == {i: plain_clean(s) for i, s in enumerate(tricky)}


def test_every_foldable_character(spark):
    source, _, expansions = fold_rules()
    chars = list(source) + list(expansions)
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    wrong = [c for i, c in enumerate(chars) if got[i] != plain_clean(f"a{c}b")]
    assert wrong == []


def test_tokens_split_fused_words_and_keep_stripped_contractions(spark):
    got = one(spark, "I cannot, we're gonna! don't Lemme wannabe", X.clean_tokens)
    assert got == ["gon", "na", "dont", "lem", "wannabe"]


def test_stop_lists(spark):
    from pyspark.ml.feature import StopWordsRemover

    for name in LANGUAGE_OF_CODE.values():
        assert list(spark_stop_words(name)) == StopWordsRemover.loadDefaultStopWords(name)
    assert "would" not in stop_words("english") and "re" in stop_words("english")
    assert "ils" in stop_words("french") and "unser" in stop_words("german")


def test_sentences(spark):
    text = (
        'Mr. Frodo met J. R. Tolkien in the U.S. The ring... was gone. It ended! "Yes." he said? '
        "Wait... Now it is 5 p.m. and late."
    )
    assert one(spark, text, X.sentences) == [
        "Mr. Frodo met J. R. Tolkien in the U.S.", "The ring... was gone.", "It ended!", '"Yes."', "he said?",
        "Wait...", "Now it is 5 p.m. and late.",
    ]


def test_naive_sentences(spark):
    assert one(spark, "short. this one is long enough.  and another long one \n.", X.naive_sentences) == [
        "this one is long enough", "and another long one",
    ]


def test_chapters_quirks(spark):
    text = "preface Chapter 1 one Chapter 2  Chapter 12 twelve"
    got = one(spark, text, X.chapters)
    assert [(c.title, c.content) for c in got] == [("Chapter 1", "one"), ("Chapter 2", ""), ("Chapter 1", "2 twelve")]
    long = one(spark, text, lambda c: X.chapters(c, r"Chapter \d+"))
    assert [c.title for c in long] == ["Chapter 1", "Chapter 2", "Chapter 12"]


def test_split_chapters_counts_empty_ones(spark):
    from corpusloom.operators.corpus import split_chapters

    df = spark.createDataFrame([(7, "x Chapter 1 a Chapter 2  Chapter 3 b")], "doc_id long, text string")
    got = [(r.chapter_no, r.content) for r in split_chapters(df).orderBy("chapter_no").collect()]
    assert got == [(1, "a"), (3, "b")]


def test_mentions_need_word_borders(spark):
    got = one(spark, "The Ring of Moria; Frodos élrond Minas  Tirith minas tirith", lambda c: X.mentions(c, ["frodo", "the ring", "moria", "lrond", "minas tirith"]))
    assert got == ["the ring", "moria", "minas tirith"]


def test_labels_and_display(spark):
    assert one(spark, " frodo , sam", X.first_item) == "frodo"
    assert one(spark, "  ", X.first_item) == "unknown"
    assert one(spark, None, X.first_item) == "unknown"
    assert one(spark, "x" * 101, X.shorten) == "x" * 100 + "..."
    assert one(spark, "x" * 100, X.shorten) == "x" * 100
    assert one(spark, "a\nb", X.one_line) == "a b"


def test_keyword_functions(spark):
    kws = F.array(F.lit("Ring"), F.lit("zz"), F.lit("Ring"))
    assert one(spark, "the RING", lambda c: X.keyword_positions(c, kws)) == {"Ring": 4}
    assert one(spark, "the RING", lambda c: X.keyword_positions(c, kws, True)) == {}
    assert one(spark, "the RING", lambda c: X.contained_keywords(c, kws)) == ["Ring", "Ring"]
    assert one(spark, "anything", lambda c: X.contains_all(c, F.array().cast("array<string>"))) is True


def test_search_tokens_match_python(spark):
    import string

    text = 'The "Quick" (brown) fox--jumps, ... over U.S.A.! «été» -- a b'
    want = [t for t in (w.strip(string.punctuation) for w in text.lower().split()) if t and t not in set(stop_words("english"))]
    assert one(spark, text, X.search_tokens) == want


def test_text_choice_prefers_the_cleaned_column(spark):
    from corpusloom.operators.mentions import keep_mentioned, tag_mentions

    df = spark.createDataFrame([("Frodo!", "frodo"), ("none", None)], "sentence string, cleaned_sentence string")
    assert [r[0] for r in df.select(X.text_choice(df)).collect()] == ["frodo", ""]
    assert [r[0] for r in df.select(X.text_choice(df, False)).collect()] == ["Frodo!", "none"]
    assert keep_mentioned(tag_mentions(df, "sentence")).count() == 1


def test_other_languages_come_from_a_table(spark):
    import pytest

    from corpusloom.functions.stopwords import stop_words_from

    table = spark.createDataFrame([("greek", "Και"), ("greek", "το"), ("greek", "d'"), ("x", "y")], "language string, word string")
    assert stop_words_from(table, "greek") == ["και", "το"]
    with pytest.raises(ValueError, match="pass a list"):
        stop_words("greek")
    with pytest.raises(ValueError, match="no list"):
        stop_words_from(table, "thai")
