"""Word networks built from an association table ``(word1, word2, mi_score)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import with_row_ids

_BROADCAST_WORDS = 100_000  # a word list up to this length (a few MB) is broadcast


def vocabulary(pairs: DataFrame) -> DataFrame:
    """Distinct words of both sides."""
    return pairs.select(F.explode(F.array("word1", "word2")).alias("word")).distinct()


def word_strength(pairs: DataFrame) -> DataFrame:
    """Sum of the scores a word takes part in; a self-pair counts twice."""
    return (
        pairs.select(F.explode(F.array("word1", "word2")).alias("word"), "mi_score")
        .groupBy("word")
        .agg(F.sum("mi_score").alias("strength"))
    )


def strongest_words(pairs: DataFrame, max_words: int = 100) -> DataFrame:
    """The ``max_words`` words of highest strength, ties by word."""
    ranked = word_strength(pairs).withColumn("strength", F.round("strength", 6))
    if max_words <= _BROADCAST_WORDS:
        return ranked.orderBy(F.desc("strength"), "word").limit(max_words)
    # a long list is numbered in place, so that no task holds all of it
    numbered = with_row_ids(ranked, [F.desc("strength"), "word"], "_at")
    return numbered.where(F.col("_at") < max_words).drop("_at")


def matrix_words(matrix: DataFrame) -> DataFrame:
    """Every word of a matrix, also those that only occur with themselves."""
    return matrix.select(F.explode(F.array("a", "b")).alias("word")).distinct()


def prune_network(pairs: DataFrame, max_words: int = 100) -> DataFrame:
    """Keep the pairs whose two words are both among the strongest ones."""
    top = strongest_words(pairs, max_words).select("word")
    if max_words <= _BROADCAST_WORDS:
        top = F.broadcast(top)
    first = top.select(F.col("word").alias("word1"))
    second = top.select(F.col("word").alias("word2"))
    return pairs.join(first, "word1", "left_semi").join(second, "word2", "left_semi")


def association_matrix(pairs: DataFrame) -> DataFrame:
    """Symmetric matrix as a sparse upper triangle ``(a, b, mi)`` with ``a <= b``.

    Where both orders of a pair are present the lower score wins. Absent cells are 0.
    """
    return (
        pairs.groupBy(
            F.least("word1", "word2").alias("a"), F.greatest("word1", "word2").alias("b")
        ).agg(F.min("mi_score").alias("mi"))
    )


def matrix_range(matrix: DataFrame) -> DataFrame:
    """One row ``(low, high, n_words)``: range over all cells, counting absent ones as 0."""
    words = matrix.select(F.explode(F.array("a", "b")).alias("w")).agg(
        F.count_distinct("w").alias("n")
    )
    cells = matrix.agg(
        F.min("mi").alias("low"),
        F.max("mi").alias("high"),
        F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)).alias("cells"),
        words.scalar().alias("n_words"),
    )
    sparse = F.col("cells") < F.col("n_words") * F.col("n_words")
    return cells.select(
        F.when(sparse, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
        F.when(sparse, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"),
        "n_words",
    )


def _scaled(value, low, high):
    width = high - low
    stretched = F.when(width == 0, value - low).otherwise((value - low) / width)
    return F.when(high > 0, stretched).otherwise(value)


def to_distance(matrix: DataFrame) -> DataFrame:
    """Distances ``(a, b, distance)`` of the listed pairs, ``a < b``.

    Min-max scaling runs over every cell of the full matrix and is skipped when no score
    is positive; the distance is one minus the scaled score.
    """
    limits = matrix_range(matrix).select(F.struct("low", "high")).scalar()
    scaled = _scaled(F.col("mi"), limits["low"], limits["high"])
    return matrix.filter(F.col("a") < F.col("b")).select(
        "a", "b", (F.lit(1.0) - scaled).alias("distance")
    )


def absent_distance(matrix: DataFrame) -> DataFrame:
    """One row ``(n_words, absent)``: the distance of every pair that is not listed."""
    limits = matrix_range(matrix)
    return limits.select(
        "n_words",
        (F.lit(1.0) - _scaled(F.lit(0.0), F.col("low"), F.col("high"))).alias("absent"),
    )
