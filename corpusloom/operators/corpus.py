"""Chapters, sentences, term frequency and windowed word association."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ordering import with_row_ids
from corpusloom.operators.word_pairs import count_pairs, number_tokens
from corpusloom.runtime import materialize

DEFAULT_WINDOW = 10
DEFAULT_MIN_FREQ = 10
_STRETCH = 4096  # rows of the document stream handled by one window group


# --- text tables ---------------------------------------------------------------------


def split_chapters(
    books: DataFrame, text: str = "text", heading: str = X.DEFAULT_HEADING
) -> DataFrame:
    """One row per chapter. Numbers count every heading; empty chapters are dropped."""
    keep = [c for c in books.columns if c != text]
    parts = books.select(*keep, F.posexplode(X.chapters(F.col(text), heading)).alias("_at", "_part"))
    return parts.select(
        *keep,
        (F.col("_at") + 1).alias("chapter_no"),
        F.col("_part.title").alias("title"),
        F.col("_part.content").alias("content"),
    ).filter(F.length("content") > 0)


def split_sentences(df: DataFrame, text: str = "content", naive: bool = False) -> DataFrame:
    """One row per sentence with a 0-based ``sentence_id`` inside each input row."""
    keep = [c for c in df.columns if c != text]
    splitter = X.naive_sentences if naive else X.sentences
    return df.select(*keep, F.posexplode(splitter(F.col(text))).alias("sentence_id", "sentence"))


def process_sentences(df: DataFrame, language: str = "english") -> DataFrame:
    """Add ``cleaned_sentence`` and ``tokens``."""
    cleaned = df.withColumn("cleaned_sentence", X.clean_text(F.col("sentence")))
    words = X.word_tokens(F.col("cleaned_sentence"))
    return cleaned.withColumn("tokens", X.drop_stop_words(words, language))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per key, such as sentences per chapter."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


# --- frequency and association -------------------------------------------------------


def word_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, frequency)``, unordered.

    The outer generator plus a null filter keeps Catalyst from inferring a size filter
    below the generator, which would evaluate the token expression a second time.
    """
    return (
        df.select(F.explode_outer(tokens).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def term_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, frequency)``, most frequent first."""
    return word_counts(df, tokens).orderBy(F.desc("frequency"), "word")


def cooccurrence(
    df: DataFrame, tokens: str = "tokens", window: int = DEFAULT_WINDOW, min_freq: int = 1, language: str = "english"
) -> DataFrame:
    """Ordered pair counts ``(word1, word2, n_pair)``; the window stops at the row border.

    Pairs counted fewer than ``min_freq`` times are left out. A column of texts stands for their
    ``clean_tokens``.
    """
    blocks, _ = _numbered(df, tokens, window, None, language)
    return count_pairs(blocks, "_block", window, min_freq)


def cooccurrence_stream(
    df: DataFrame, order: list, tokens: str = "tokens", window: int = DEFAULT_WINDOW, min_freq: int = 1, language: str = "english"
) -> DataFrame:
    """Ordered pair counts over the concatenation of all rows in ``order``."""
    blocks, across = _numbered(df, tokens, window, order, language)
    return count_pairs(blocks, "_block", window, min_freq, across)


def _numbered(df: DataFrame, tokens: str, window: int, order: list | None, language: str) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of numbered tokens, written once, and with ``order`` the pairs across the row borders."""
    blocks = materialize(number_tokens(df, tokens, window - 1, order, language))
    across = materialize(_pairs_across(blocks.drop("_block"), order, window)) if order else None
    return blocks, across


def _pairs_across(edges: DataFrame, order: list, window: int) -> DataFrame:
    """Pairs of the concatenated stream that cross a row border.

    Pairs inside a row need no global order. Only the pairs that cross a border do, and for
    those the first and last ``window - 1`` tokens of each row suffice: just these edges are
    range-sorted and numbered. Stretches of consecutive rows borrow the heads of the next
    ``window - 1`` rows, so no stretch needs more than its own rows plus a constant halo.
    """
    reach = window - 1
    numbered = with_row_ids(edges.filter(F.size("_head") > 0), order, "_rid").drop(*order)
    own = F.floor(F.col("_rid") / _STRETCH)
    borrowed = (F.col("_rid") % _STRETCH < reach) & (own > 0)
    stretches = F.when(borrowed, F.array(own, own - 1)).otherwise(F.array(own))
    placed = numbered.withColumn("_stretch", F.explode(stretches))
    following = (
        Window.partitionBy("_stretch").orderBy("_rid").rowsBetween(1, reach)
    )
    return (
        placed.withColumn("_next", F.flatten(F.collect_list("_head").over(following)))
        .filter(F.col("_stretch") == own)
        .select("_next", F.size("_tail").alias("_n"), F.posexplode("_tail").alias("_i", "word1"))
        # the token at index i of an n-token tail still reaches (reach - n + 1 + i) tokens ahead
        .select(
            "word1",
            F.explode(
                F.expr(f"slice(_next, 1, greatest({reach} - _n + 1 + _i, 0))")
            ).alias("word2"),
        )
    )


def pmi_measure(n_pair: Column, n_1: Column, n_2: Column, total: Column) -> Column:
    """Pointwise mutual information in bits."""
    return F.log2(n_pair * total) - F.log2(n_1 * n_2)


def association(
    pairs: DataFrame,
    words: DataFrame,
    window: int = DEFAULT_WINDOW,
    min_freq: int = DEFAULT_MIN_FREQ,
    measure: Callable[[Column, Column, Column, Column], Column] = pmi_measure,
) -> DataFrame:
    """Score pairs counted at least ``min_freq`` times: ``(word1, word2, n_pair, mi_score)``.

    ``measure`` receives the pair count divided by ``window - 1``, both word counts and the
    number of tokens.
    """
    frequent = pairs.filter(F.col("n_pair") >= min_freq)
    first = words.select(F.col("word").alias("word1"), F.col("frequency").alias("n_1"))
    second = words.select(F.col("word").alias("word2"), F.col("frequency").alias("n_2"))
    total = words.agg(F.sum("frequency").cast("double").alias("_n")).scalar()
    return _scored(frequent.join(first, "word1").join(second, "word2"), total, window, measure)


def _scored(pairs: DataFrame, total: Column, window: int, measure: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    score = measure(
        F.col("n_pair") / F.lit(float(window - 1)),
        F.col("n_1").cast("double"),
        F.col("n_2").cast("double"),
        total,
    )
    return pairs.select("word1", "word2", "n_pair", score.alias("mi_score"))


def pmi_pairs(
    df: DataFrame,
    tokens: str = "tokens",
    window: int = DEFAULT_WINDOW,
    min_freq: int = DEFAULT_MIN_FREQ,
    order: list | None = None,
    measure: Callable[[Column, Column, Column, Column], Column] = pmi_measure,
    language: str = "english",
) -> DataFrame:
    """Association table of a table of tokens or texts, in no order.

    With ``order`` the window runs over the whole token stream, else it stops at row borders.
    The corpus is tokenised and numbered once.
    """
    blocks, across = _numbered(df, tokens, window, order, language)
    kept = count_pairs(blocks, "_block", window, min_freq, across, counts=True)
    return _scored(kept, blocks.agg(F.sum("_block.n").cast("double").alias("_n")).scalar(), window, measure)


def pmi(
    df: DataFrame,
    tokens: str = "tokens",
    window: int = DEFAULT_WINDOW,
    min_freq: int = DEFAULT_MIN_FREQ,
    order: list | None = None,
    measure: Callable[[Column, Column, Column, Column], Column] = pmi_measure,
    language: str = "english",
) -> DataFrame:
    """``pmi_pairs``, best first; written for the sort, which reads them twice."""
    pairs = materialize(pmi_pairs(df, tokens, window, min_freq, order, measure, language))
    return pairs.orderBy(F.desc("mi_score"), "word1", "word2")
