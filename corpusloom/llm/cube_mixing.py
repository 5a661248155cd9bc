"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a share of the words; the share divided by its size is the rate at which its
documents are taken. Whole copies are plain; the fraction that is left is an inclusion
probability. The flight moves the probabilities of a block of documents along directions that
change neither the expected words nor the expected number of documents, until they are 0 or 1.
At most two documents of a block stay undecided; they go on to the next round in new blocks, until
one block holds what is left of a source. Blocks are cut in order of size, and the smallest
documents of a source wait for its last block, so that long ones always have others to make up for
them. The last undecided documents are landed on the side that comes closest to the target.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.length_buckets import word_count
from corpusloom.operators.ordering import with_row_ids, with_running_total
from corpusloom.runtime import materialize, materialize_counted

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
#: Most copies of a document, and with it the largest target of a source.
COPIES = 2
BLOCK = 1024
SEED = 42
_SENT_SOURCES = 1 << 17
_EDGE = 1e-9
_BLOCKS_A_TASK = 16


# --- targets -------------------------------------------------------------------------


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, copies: int = COPIES
) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, ...)``.

    Weights go round by source in code point order, null last. What a source cannot take, being
    at ``copies`` times its size, is shared again by weight. The level at which the shares settle
    is found exactly, from sums only; sources stay where they are.
    """
    placed = materialize(with_row_ids(sources, [F.col("source").isNull(), "source"], "source_no"))
    kind = (F.col("source_no") % len(weights)).cast("int")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), kind)
    wanted = share * (placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # a source of weight w is full when it has fewer words than full_below[w]
    full_below, level = dict.fromkeys(weights, 0), Fraction(0)
    while True:
        limit = F.get(F.array(*[F.lit(full_below[w]).cast("long") for w in weights]), kind)
        full = F.col("source_size") < limit
        held, open_weight = placed.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)),
        ).first()
        if open_weight:
            level = (wanted - copies * held) / open_weight
        now = {w: -(-level * w // copies) for w in weights}
        if now == full_below or not open_weight:
            break
        full_below = now
    even = F.get(F.array(*[F.lit(float(level * w)) for w in weights]), kind)
    target = F.when(full, F.col("source_size") * float(copies)).otherwise(even)
    return placed.withColumn("target", target)


# --- flight and landing --------------------------------------------------------------


def fly(sizes: np.ndarray, chance: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, keeping their sum and the sum weighted by size.

    The largest open unit is pushed; all others give way by weighted least squares, so that the
    step stays in the null-space of both totals. A step goes as far as the first unit that meets
    a border, to either side with the odds that leave every expectation as it is. At most two
    units, for which no direction is left, stay open.
    """
    p = chance.astype(float).copy()
    queue = np.argsort(-sizes, kind="stable")
    scale = max(float(sizes.max(initial=0)), 1.0)
    s = sizes / scale
    is_open = (p > 0) & (p < 1)
    for unit in queue:
        while is_open[unit]:
            rest = np.flatnonzero(is_open)
            rest = rest[rest != unit]
            step = _compensation(s[rest], p[rest] * (1 - p[rest]), s[unit])
            if step is None:
                break
            moved = np.append(rest, unit)
            u = np.append(step, 1.0)
            here = p[moved]
            with np.errstate(divide="ignore"):
                up = np.where(u > 0, (1 - here) / u, np.where(u < 0, -here / u, np.inf)).min()
                down = np.where(u > 0, here / u, np.where(u < 0, (here - 1) / u, np.inf)).min()
            by = up if draw.random() * (up + down) < down else -down
            here = here + by * u
            here[here < _EDGE] = 0.0
            here[here > 1 - _EDGE] = 1.0
            p[moved] = here
            is_open[moved] = (here > 0) & (here < 1)
    return p


def _compensation(s: np.ndarray, room: np.ndarray, size: float) -> np.ndarray | None:
    """Changes of the other units that undo one unit's step in both totals, or None."""
    if not len(s):
        return None
    total, first, second = room.sum(), (room * s).sum(), (room * s * s).sum()
    gap = total * second - first * first
    if gap > 1e-12 * total * total:
        a, b = (second - first * size) / gap, (total * size - first) / gap
        return -room * (a + b * s)
    # all others are of one size: they can only make up for a unit of that size
    return -room / total if abs(first / total - size) < 1e-9 else None


def land(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide what is open (two units at most after a flight): closest in words, then in units."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    options = np.array(list(itertools.product((0.0, 1.0), repeat=len(left))))
    off = options - p[left]
    words, units = np.abs(off @ sizes[left]), np.abs(off.sum(1))
    out = p.copy()
    out[left] = options[np.lexsort((units, np.round(words, 6)))[0]]
    return out


def _flight(seed: int, turn: int):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_at", kind="stable")
        sizes = block["size"].to_numpy()
        draw = np.random.default_rng([seed, turn, *map(int, key)])
        p = fly(sizes, block["chance"].to_numpy(), draw)
        if block["whole_source"].iloc[0]:
            p = land(sizes, p)
        block["chance"] = p
        return block

    return run


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    copies: int = COPIES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``size`` defaults to the words of ``text``; a null text has none. ``taken`` is the size times
    the copies the mix takes, at most ``copies``. Every row counts, repeated rows and rows with a
    null id too; a null source is a source of its own and comes last. Documents without words are
    balanced by number only. The result depends on the rows and the seed, not on their order or
    partitions (rows alike in id, source and size may trade places). An empty table gives no rows.
    Other columns are ignored.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size")
        )
    )
    sources, many = materialize_counted(
        source_targets(
            rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")),
            weights, share, copies,
        )
    )
    send = F.broadcast if many <= _SENT_SOURCES else (lambda df: df)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target", rate.alias("_rate"))
    units = rows.join(send(named), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_no", "source_size", "target",
        F.floor("_rate").alias("whole"),
        (F.col("_rate") - F.floor("_rate")).alias("chance"),
    )
    edge = (F.col("chance") <= _EDGE) | (F.col("chance") >= 1 - _EDGE)
    settled = [units.where(edge).withColumn("chance", F.round("chance"))]
    state, turn = units.where(~edge), 0
    while True:
        counts = state.groupBy("source_no").agg(F.count(F.lit(1)).alias("_n"))
        starts = materialize(with_running_total(counts, ["source_no"], "_n", "_start"))
        mixed = F.xxhash64(F.lit(seed), F.lit(turn), "doc_id")
        order = ["source_no", F.desc("size"), "_mix", "doc_id", "chance"]
        ordered = with_row_ids(state.withColumn("_mix", mixed), order, "_at")
        place, whole = F.col("_at") - F.col("_start"), F.col("_n") <= block
        blocks = ordered.join(send(starts), "source_no").select(
            *state.columns,
            "_at",
            F.floor(place / block).alias("block"),
            whole.alias("whole_source"),
            (~whole & (place >= F.col("_n") - block // 2)).alias("waits"),
        )
        # flights are work, not bytes: tasks go by the number of blocks
        tasks = 1 + (starts.agg(F.sum("_n")).first()[0] or 0) // (_BLOCKS_A_TASK * block)
        ready = blocks.where(~F.col("waits")).repartition(tasks, "source_no", "block")
        flown, left = _written(ready.groupBy("source_no", "block").applyInPandas(_flight(seed, turn), ready.schema))
        settled.append(flown.where((F.col("chance") == 0) | (F.col("chance") == 1)).select(state.columns))
        if not left:
            break
        still = flown.where((F.col("chance") > 0) & (F.col("chance") < 1))
        state = materialize(still.unionByName(blocks.where("waits")).select(state.columns))
        turn += 1
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    copied = (F.col("whole") + F.col("chance")).cast("long")
    return whole.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copied).alias("taken"), copied.alias("copies")
    )


def _written(flown: DataFrame) -> tuple[DataFrame, int]:
    """The rows after a flight, written, and how many are still open."""
    from pyspark.sql import Observation

    seen = Observation()
    table = materialize(flown.observe(seen, F.count_if((F.col("chance") > 0) & (F.col("chance") < 1)).alias("n")))
    return table, seen.get["n"]
