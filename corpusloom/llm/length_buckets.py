"""Packing into optimal length buckets.

The histogram of lengths over all documents is small, because lengths are rounded up to a grid
of ``2**GRID_BITS`` values an octave (lengths below that are exact). Dynamic programming over it
chooses the bucket bounds that minimise padding. Inside each bucket, batches take as many
documents as the token budget holds at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import with_row_ids
from corpusloom.runtime import materialize

GRID_BITS = 8
BUCKETS, BUDGET = 16, 65536


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def on_grid(length: Column) -> Column:
    """Length rounded up so that only its ``GRID_BITS + 1`` leading bits are set."""
    spare = F.greatest(F.length(F.bin(length)) - (GRID_BITS + 1), F.lit(0))
    return F.ceil(length / F.pow(F.lit(2.0), spare)).cast("long") * F.pow(F.lit(2.0), spare).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    ``lengths`` ascending, with the number of documents and the sum of their true lengths. Of
    equally good choices the one with smaller lower buckets is taken.
    """
    m = len(lengths)
    if not m:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    spent = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    best = lengths * below[1:] - spent[1:]  # one bucket for everything up to j
    choice = []
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.zeros(m, np.int64)
        for lo in range(0, m, 256):
            j = np.arange(lo, min(lo + 256, m))
            i = np.arange(1, j[-1] + 1)  # first bin of the last bucket
            if not len(i):
                continue
            cost = best[i - 1] + lengths[j, None] * (below[j + 1, None] - below[i]) - (spent[j + 1, None] - spent[i])
            cost[i > j[:, None]] = np.iinfo(np.int64).max
            k = cost.argmin(1)
            least = cost[np.arange(len(j)), k]
            better = least < best[j]
            new[j[better]], cut[j[better]] = least[better], i[k[better]]
        choice.append(cut)
        best = new
    bounds, j = [], m - 1
    for cut in reversed(choice):
        if cut[j]:
            bounds.append(int(lengths[j]))
            j = int(cut[j]) - 1
    return [*reversed(bounds + [int(lengths[j])])]


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, padding, batch_id.

    ``length`` defaults to the number of words of ``text``. Every row is placed: an empty or
    null text has length 0, a text beyond ``budget`` is a batch of its own, repeated rows are
    placed each. ``padding`` is what the row wastes at its bucket's length. A batch never holds
    more than ``budget`` padded tokens unless it is one document; batches are filled in order of
    id. An empty table gives no rows. Columns besides the used ones are ignored.
    """
    length = word_count(F.col("text")) if length is None else length
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("_row"),
        )
    ).withColumn("_grid", on_grid(F.col("n_tokens")))
    # bounded by the grid: 256 values for each doubling of the longest length
    histogram = (
        rows.groupBy("_grid").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
        .orderBy("_grid").collect()
    )
    grid, n, total = (np.array([r[i] for r in histogram], np.int64) for i in range(3))
    bounds = optimal_bounds(grid, n, total, buckets)
    place = np.searchsorted(np.array(bounds), grid) if bounds else np.empty(0, np.int64)
    many = np.bincount(place, weights=n, minlength=len(bounds)).astype(np.int64)
    holds = [max(1, budget // max(b, 1)) for b in bounds]
    batches = [-(-int(m) // h) for m, h in zip(many, holds, strict=True)]

    def by_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in [*values, 0]]), F.col("bucket"))

    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("_grid") > b).cast("int")
    placed = rows.withColumn("bucket", bucket).drop("_grid")
    numbered = with_row_ids(placed, ["bucket", "doc_id", "_row"], "_rank")
    first_row = np.concatenate([[0], np.cumsum(many)])[:-1].tolist()
    first_batch = np.concatenate([[0], np.cumsum(batches)])[:-1].astype(int).tolist()
    within = F.floor((F.col("_rank") - by_bucket(first_row)) / by_bucket(holds))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        by_bucket(bounds).alias("bucket_length"),
        (by_bucket(bounds) - F.col("n_tokens")).alias("padding"),
        (by_bucket(first_batch) + within).cast("long").alias("batch_id"),
    )
