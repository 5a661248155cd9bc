"""Labelled sentence pairs for training an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ordering import with_row_ids
from corpusloom.runtime import materialize

# Primes of the form 3n + 2, so that cubing is one to one; every product stays inside BIGINT.
_PRIMES = (2_147_483_579, 2_147_483_549)
_FACTORS = ((7_919_017, 104_729_011, 15_485_863), (32_452_843, 49_979_687, 86_028_121))
DRAWS = _PRIMES[0] * _PRIMES[1]  # number of possible draws, about 2**62

ADJACENT, SKIP_ONE, FAR, OTHER = 0.8, 0.4, 0.2, 0.1  # labels by kind of pair


def draw(doc: Column, i: Column, salt: int) -> Column:
    """Pseudo-random BIGINT in ``[0, DRAWS)`` from the position of a sentence alone.

    Plain arithmetic: the same on every run, partitioning and engine. Two independent fields
    make one number, so no corpus runs out of different draws.
    """
    fields = []
    for prime, (a, b, c) in zip(_PRIMES, _FACTORS, strict=True):
        p = F.lit(prime).cast("long")
        mixed = ((doc % p) * a + (i % p) * b + F.lit(salt * c).cast("long")) % p
        fields.append(mixed * mixed % p * mixed % p)
    return fields[0] * F.lit(_PRIMES[1]).cast("long") + fields[1]


def training_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    max_samples: int | None = None,
    far_share: float = 0.7,
) -> DataFrame:
    """Pairs ``(doc_id, i, kind, text_a, text_b, label)``.

    Per sentence: the next one; the one after it in documents of more than 3 sentences; then
    by a draw either a later one of the same document (more than 5 sentences) or a sentence of
    a document drawn from all of them. Documents of fewer than 3 sentences start no pairs.
    """
    # split once; the pairs of a document, the drawn ones and their targets all read what was written
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), X.naive_sentences(F.col(text)).alias("s")))
    numbered = materialize(with_row_ids(rows.select("doc_id"), ["doc_id"], "doc_no"))
    total = numbered.agg(F.count(F.lit(1))).scalar()
    n = F.size("s")
    at = lambda salt, i: draw(F.col("doc_id"), i.cast("long"), seed + salt)
    low = lambda i: F.least(i + 3, n - 1)
    far = lambda i: low(i) + at(2, i) % (n - low(i))
    i = F.col("i")

    def starts(*beside: Column) -> DataFrame:
        """A row for each sentence with those it may be paired with, so that no row carries its whole document."""
        return (
            rows.filter(n >= 3)
            .select("doc_id", n.alias("n"), F.posexplode(F.arrays_zip(F.slice("s", 1, n - 1).alias("text_a"), *beside)).alias("i", "t"))
            .withColumn("stays", (at(1, i) < F.lit(int(far_share * 1000) * (DRAWS // 1000)).cast("long")) & (F.col("n") > 5))
        )

    later = F.transform(
        F.transform(F.sequence(F.lit(0), n - 2), far), lambda k: F.struct(k.alias("at"), F.get("s", k).alias("text"))
    )
    pair = lambda kind, other, label: F.struct(
        F.lit(kind).alias("kind"), F.col("t.text_a").alias("text_a"), other.alias("text_b"), F.lit(label).alias("label")
    )
    inside = F.array_compact(
        F.array(
            pair("adjacent", F.col("t.next"), ADJACENT),
            F.when((F.col("n") > 3) & (i < F.col("n") - 2), pair("skip", F.col("t.skip"), SKIP_ONE)),
            F.when(F.col("stays") & (F.col("t.later.at") > i + 2), pair("far", F.col("t.later.text"), FAR)),
        )
    )
    columns = ["doc_id", "i", "p.kind", "p.text_a", "p.text_b", "p.label"]
    near = starts(F.slice("s", 2, n - 1).alias("next"), F.slice("s", 3, n - 2).alias("skip"), later.alias("later"))
    local = near.select("doc_id", "i", F.explode(inside).alias("p"))
    asked = starts().filter(~F.col("stays") & (total > 1)).select(
        "doc_id", "i", "t", (at(3, i) % total).alias("doc_no"), at(4, i).alias("other_at")
    )
    # draws are spread evenly over the documents, so no document is asked for too often
    named = asked.join(numbered.withColumnRenamed("doc_id", "other_id"), "doc_no")
    targets = rows.filter(n > 0).select(F.col("doc_id").alias("other_id"), F.col("s").alias("o"))
    drawn = F.get("o", (F.col("other_at") % F.size("o")).cast("int"))
    # exploded, as an array read by an expression further up would travel whole to Python
    away = named.join(targets, "other_id").select("doc_id", "i", F.explode(F.array(pair("other", drawn, OTHER))).alias("p"))
    pairs = local.select(columns).unionByName(away.select(columns))
    if max_samples is not None:
        pairs = pairs.orderBy("doc_id", "i", "kind").limit(max_samples)
    return pairs


def split_pairs(pairs: DataFrame, most: int = 500, share: int = 10) -> DataFrame:
    """Add ``split``: the first ``min(most, n / share)`` pairs are ``eval``, the rest ``train``."""
    pairs = materialize(pairs)
    key = ["doc_id", "i", "kind"]
    n_pairs = pairs.agg(F.count(F.lit(1))).scalar()
    first = pairs.select(key).orderBy(key).limit(most)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(key)))  # at most ``most`` rows
    held = ranked.filter(F.col("_rank") <= F.floor(n_pairs / share)).select(*key, F.lit("eval").alias("split"))
    return pairs.join(F.broadcast(held), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))
