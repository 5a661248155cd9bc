"""Exact vector search and similarity joins.

Small query sets (their size is measured first) are broadcast and every corpus partition
keeps a running top-k per query. Larger ones use a block join: both sides are cut into
blocks of bounded size that hold neighbouring vectors, block pairs whose best possible
score is too low are dropped, and each remaining pair is one matrix product. A task holds a
set of left blocks and meets right blocks one by one, so a block travels once a set and not
once a pair, and a row hands on its k best of all it has met. Blocks are cut from range
partitions on (group, cell, hash), so neither a hot group nor many copies of one vector ends
up in one task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import doubles, dot, unit
from corpusloom.operators.descent import descend, walk
from corpusloom.operators.ordering import with_row_ids
from corpusloom.runtime import materialize

BROADCAST_BYTES = 64 << 20  # largest query matrix sent to every executor
_BLOCK_BYTES = 1 << 20
_BLOCK_ROWS = 1024
_TILE_BYTES = 32 << 20  # left vectors held by one task
_STRIPE_BYTES = 128 << 20  # right vectors that pass by one task
_CELLS = 1024  # at most; their centres are broadcast (a few MB)
_PRODUCT_CELLS = 4 << 20  # scores held at once by one task
_DECIMALS = 6  # scores are compared at this precision; ties go to the smaller id
_SLACK = 1e-6


def _scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix, higher is closer: inner product, or minus the euclidean distance."""
    products = left @ right.T
    if metric == "cosine":
        return np.round(products, _DECIMALS)
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * products
    return np.round(-np.sqrt(np.maximum(squares, 0.0)), _DECIMALS)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of every row among flat candidates."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], int)
    lengths = np.diff(np.r_[starts, len(rows)])
    keep = np.arange(len(rows)) - np.repeat(starts, lengths) < k
    return rows[keep], ids[keep], scores[keep]


def _candidates(scores: np.ndarray, ids: np.ndarray, k: int | None, floor: np.ndarray | float):
    """Flat (row, id, score) of everything that can be among the k best of its row."""
    if k is not None and scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        floor = np.maximum(kth, floor)
    limit = np.broadcast_to(np.asarray(floor, dtype=float), (scores.shape[0],))
    rows, cols = np.nonzero(scores >= limit[:, None])
    return rows, ids[cols], scores[rows, cols]


def _prepared(df: DataFrame, id_col: str, vec_col: str, metric: str, group: str | None) -> DataFrame:
    vector = unit(F.col(vec_col)) if metric == "cosine" else doubles(F.col(vec_col))
    return df.filter(F.col(vec_col).isNotNull()).select(
        (F.col(group).cast("string") if group else F.lit("")).alias("grp"),
        F.col(id_col).cast("long").alias("id"),
        vector.alias("vec"),
    )


def _top_by_broadcast(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    held = queries.select("id", "vec").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast(
        (held["id"].to_numpy(dtype=np.int64), np.vstack(held["vec"]) if len(held) else np.zeros((0, 1)))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        rows, ids, scores = np.array([], int), np.array([], np.int64), np.array([])
        step = max(1, _PRODUCT_CELLS // max(len(names), 1))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                found = _candidates(
                    _scores(matrix, np.vstack(part["vec"]), metric), part["id"].to_numpy(), k, -np.inf
                )
                rows, ids, scores = _best(
                    *(np.concatenate(pair) for pair in zip((rows, ids, scores), found)), k
                )
        yield pd.DataFrame({"query_id": names[rows], "id": ids, "score": scores})

    if not len(held):
        return corpus.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    # every task hands on k rows per query, so a task takes several splits of a large corpus
    tasks = 4 * corpus.sparkSession.sparkContext.defaultParallelism
    return (
        corpus.select("id", "vec")
        .coalesce(tasks)
        .mapInPandas(scan, "query_id long, id long, score double")
    )


# --- blocks --------------------------------------------------------------------------


def _pivots(df: DataFrame) -> np.ndarray:
    """A few vectors picked by hash: the cell centres. Small groups get by with one cell."""
    largest = df.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, min(_CELLS, largest // (4 * _BLOCK_ROWS)))
    rows = df.select("vec").orderBy(F.xxhash64("grp", "id")).limit(cells).collect()
    return np.array([r.vec for r in rows], dtype=float) if rows else np.zeros((1, 1))


def _cuts(cells: np.ndarray, size: int) -> list[int]:
    """Start rows of the blocks of one group: a new block when full, or at a change of cell
    unless the block is still small."""
    changes = set((np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist())
    starts, at = [0], 0
    for row in sorted(changes | set(range(size, len(cells), size))):
        while row - at > size:
            at += size
            starts.append(at)
        if row - at == size or (row in changes and row - at >= size // 4):
            at = row
            starts.append(at)
    while len(cells) - at > size:
        at += size
        starts.append(at)
    return starts


def _blocks(
    df: DataFrame, pivots: np.ndarray, metric: str, k: int | None = None, floor: float = -np.inf
) -> DataFrame:
    """Blocks ``(grp, cell, block, n, ids, data, center, radius, reach, floor, floors)``.

    ``floors`` is the score a candidate must reach to matter for each row: ``floor``, or with
    ``k`` the k-th best score the row has inside its own block.
    """
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        centers = shared.value
        x = np.vstack(vectors)
        gaps = (centers**2).sum(1)[None, :] - 2 * (x @ centers.T)
        return pd.Series(gaps.argmin(1).astype("int32"))

    def floors_of(part: np.ndarray) -> np.ndarray:
        if k is None or len(part) < k:
            return np.full(len(part), floor)
        return np.partition(_scores(part, part, metric), len(part) - k, axis=1)[:, len(part) - k]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, run in batch.groupby("grp", sort=False):
                matrix = np.vstack(run["vec"]).astype(float)
                size = max(16, min(_BLOCK_ROWS, _BLOCK_BYTES // (8 * matrix.shape[1])))
                ids, cells = run["id"].to_numpy(), run["cell"].to_numpy()
                starts = _cuts(cells, size)
                out = []
                for start, end in zip(starts, [*starts[1:], len(run)]):
                    part, cell = matrix[start:end], cells[start]
                    center, floors = part.mean(0), floors_of(part)
                    out.append(
                        {
                            "grp": grp,
                            "cell": cell,
                            "block": uuid.uuid4().hex,
                            "n": len(part),
                            "ids": ids[start:end],
                            "data": part.tobytes(),
                            "center": center,
                            "radius": np.sqrt(((part - center) ** 2).sum(1)).max(),
                            "reach": np.sqrt(((part - shared.value[cell]) ** 2).sum(1)).max(),
                            "floor": floors.min(),
                            "floors": floors,
                        }
                    )
                yield pd.DataFrame(out)

    celled = df.withColumn("cell", cell_of("vec"))
    order = ["grp", "cell", F.xxhash64("id")]
    return materialize(
        celled.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(
            pack,
            "grp string, cell int, block string, n int, ids array<long>, data binary, "
            "center array<double>, radius double, reach double, floor double, floors array<double>",
        )
    )


def _ceiling(metric: str, c1, r1, c2, r2):
    """Best score any vector around ``c1`` can have with any vector around ``c2``."""
    if metric == "cosine":
        # Cauchy-Schwarz on the deviations from the two centres
        spread = r1 * F.sqrt(dot(c2, c2)) + r2 * F.sqrt(dot(c1, c1)) + r1 * r2
        return dot(c1, c2) + spread
    gap = F.zip_with(c1, c2, lambda x, y: x - y)
    return -F.greatest(F.sqrt(dot(gap, gap)) - r1 - r2, F.lit(0.0))


def _block_pairs(left: DataFrame, right: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Block pairs ``(grp, left_block, right_block)`` that can reach the floor of the left one.

    Cells are compared first: there are at most ``_CELLS`` of them per group.
    """
    spark = left.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>"
    )

    def cells(blocks: DataFrame, side: str) -> DataFrame:
        summary = blocks.groupBy("grp", "cell").agg(
            F.max("reach").alias("reach"), F.min("floor").alias("floor")
        )
        return summary.join(F.broadcast(centers), "cell").select(
            "grp", *[F.col(c).alias(f"{side}_{c}") for c in ("cell", "pivot", "reach", "floor")]
        )

    def briefs(blocks: DataFrame, side: str) -> DataFrame:
        return blocks.select(
            "grp", *[F.col(c).alias(f"{side}_{c}") for c in ("cell", "block", "center", "radius", "floor")]
        )

    near_cells = (
        cells(left, "left")
        .join(cells(right, "right"), "grp")
        .filter(
            _ceiling(metric, F.col("left_pivot"), F.col("left_reach"), F.col("right_pivot"), F.col("right_reach"))
            >= F.col("left_floor") - _SLACK
        )
        .select("grp", "left_cell", "right_cell")
    )
    return (
        near_cells.join(briefs(left, "left"), ["grp", "left_cell"])
        .join(briefs(right, "right"), ["grp", "right_cell"])
        .filter(
            _ceiling(metric, F.col("left_center"), F.col("left_radius"), F.col("right_center"), F.col("right_radius"))
            >= F.col("left_floor") - _SLACK
        )
        .select("grp", "left_block", "right_block")
    )


def _tiles(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of every tile: its left blocks, then its right blocks with the left ones they meet.

    A tile is a set of neighbouring left blocks, of at most ``_TILE_BYTES``, and one of several
    stripes of the right blocks. A block travels once for every tile it is needed in.
    """
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    weight = F.max(F.col("n") * F.size("center") * 8)
    sizes = [side.agg(F.count(F.lit(1)).alias("blocks"), weight.alias("bytes")).first() for side in (left, right)]
    held, passed = [(s.blocks, max(s.bytes or 1, 1)) for s in sizes]
    per_set = max(1, min(_TILE_BYTES // held[1], held[0] // math.isqrt(tasks)))
    sets = max(1, -(-held[0] // per_set))
    stripes = min(max(-(-tasks // sets), -(-passed[0] * passed[1] // _STRIPE_BYTES)), max(1, passed[0]))

    def placed(blocks: DataFrame, side: str, place: Column) -> DataFrame:
        at = with_row_ids(blocks.select("grp", "cell", "block"), ["grp", "cell", "block"], "at")
        return at.select(F.col("block").alias(f"{side}_block"), place.cast("int").alias(side))

    met = (
        pairs.join(placed(left, "left", F.floor(F.col("at") / per_set)), "left_block")
        .join(placed(right, "right", F.col("at") % stripes), "right_block")
        .select("left", "right", "left_block", "right_block")
    )
    met = materialize(met)

    def side(keys: DataFrame, blocks: DataFrame, later: bool, floors: Column) -> DataFrame:
        return keys.join(blocks, "block").select(
            "left", "right", F.lit(later).alias("later"), "block", "n", "ids", "data", floors.alias("floors"), "lefts"
        )

    first = met.select("left", "right", F.col("left_block").alias("block"), F.array().cast("array<string>").alias("lefts"))
    second = met.groupBy("left", "right", F.col("right_block").alias("block")).agg(F.collect_list("left_block").alias("lefts"))
    rows = side(first.distinct(), left, False, F.col("floors")).unionByName(
        side(second, right, True, F.array().cast("array<double>"))
    )
    return rows.repartition(sets * stripes, "left", "right").sortWithinPartitions("left", "right", "later")


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=float).reshape(n, -1)


def _over(left: np.ndarray, right: np.ndarray, floors: np.ndarray, metric: str):
    """Flat (row, column, score) of the scores that reach the floor of their row."""
    products = left @ right.T
    if metric == "cosine":
        rows, cols = np.nonzero(products >= (floors - _SLACK)[:, None])
        scores = np.round(products[rows, cols], _DECIMALS)
    else:
        squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * products
        rows, cols = np.nonzero(squares <= (np.maximum(_SLACK - floors, 0.0) ** 2)[:, None])
        scores = np.round(-np.sqrt(np.maximum(squares[rows, cols], 0.0)), _DECIMALS)
    keep = scores >= floors[rows]
    return rows[keep], cols[keep], scores[keep]


class _LeftBlock:
    """A left block and the best candidates its rows have met."""

    def __init__(self, row, k: int | None):
        self.ids, self.matrix, self.k = np.asarray(row.ids), _matrix(row.data, row.n), k
        self.floors = np.array(row.floors, dtype=float)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.found.append((rows, ids, scores))
        self.waiting += len(rows)
        if self.waiting > 2 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the k best of every row; who has k of them needs the last one's score from now on."""
        rows, ids, scores = _best(*(np.concatenate(part) for part in zip(*self.found)), self.k)
        full = np.bincount(rows, minlength=len(self.ids)) >= self.k
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, rows, scores)
        self.floors = np.where(full, np.maximum(self.floors, worst), self.floors)
        self.found, self.waiting = [(rows, ids, scores)], 0
        return rows, ids, scores


def _score_blocks(tiles: DataFrame, k: int | None, metric: str, once: bool) -> DataFrame:
    """One matrix product per block pair; ``once`` keeps each unordered id pair once.

    A tile holds its left blocks and meets the right ones one by one; with ``k`` it hands on the
    best k of every row.
    """

    def best(held: dict[str, _LeftBlock]) -> Iterator[pd.DataFrame]:
        for block in held.values():
            if block.found:
                rows, ids, scores = block.settle()
                yield pd.DataFrame({"query_id": block.ids[rows], "id": ids, "score": scores})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held = None, {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if tile != (row.left, row.right):
                    yield from best(held)
                    tile, held = (row.left, row.right), {}
                if not row.later:
                    held[row.block] = _LeftBlock(row, k)
                    continue
                right_ids, right = np.asarray(row.ids), _matrix(row.data, row.n)
                for name in row.lefts:
                    block = held[name]
                    rows, cols, scores = _over(block.matrix, right, block.floors, metric)
                    if k is not None:
                        if len(rows):
                            block.add(rows, right_ids[cols], scores)
                        continue
                    query, ids = block.ids[rows], right_ids[cols]
                    if once:
                        keep = query < ids if name == row.block else query != ids
                        query, ids, scores = query[keep], ids[keep], scores[keep]
                        query, ids = np.minimum(query, ids), np.maximum(query, ids)
                    yield pd.DataFrame({"query_id": query, "id": ids, "score": scores})
        yield from best(held)

    return tiles.mapInPandas(score, "query_id long, id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- operators -----------------------------------------------------------------------


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    corpus_id: str = "id",
    corpus_vec: str = "embedding",
    metric: str = "cosine",
    broadcast_bytes: int = BROADCAST_BYTES,
    graph: DataFrame | None = None,
) -> DataFrame:
    """The k closest corpus rows of every query: ``(query_id, id, score, rank)``, exact.

    With ``graph(src, dst)``, a neighbour graph of the corpus, queries walk along its edges
    instead: approximate, and only rows near the query are met.
    """
    q = _prepared(queries, query_id, query_vec, metric, None)
    c = _prepared(corpus, corpus_id, corpus_vec, metric, None)
    if graph is not None:
        return walk(q.select(F.col("id").alias("query_id"), "vec"), c, graph, k, metric)
    size = q.agg(F.coalesce(F.sum(F.size("vec") * 8 + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return _ranked(_top_by_broadcast(q, c, k, metric), k)
    pivots = _pivots(c)
    right = _blocks(c, pivots, metric)
    left = _blocks(q, pivots, metric)
    pairs = _block_pairs(left, right, pivots, metric)
    return _ranked(_score_blocks(_tiles(pairs, left, right), k, metric, False), k)


def neighbours(
    df: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    metric: str = "cosine",
    group: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """The k closest rows of every row, itself included: ``(query_id, id, score, rank)``.

    With ``group`` only rows of the same group are compared; ids must be unique overall.
    Exact, unless ``approximate`` asks for neighbour-of-neighbour descent.

    Copies of a vector share one list of neighbours, and as ties go to the smaller id only
    the first k copies can be on any list. So the search runs on at most k copies of each
    vector and the other copies look their list up.
    """
    rows = _prepared(df, id_col, vec_col, metric, group)
    copies = Window.partitionBy("grp", "vec").orderBy("id")
    seen = Observation()
    few = materialize(
        rows.withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= k)
        .observe(seen, F.count_if(F.col("_copy") > 1).alias("copies"))
        .drop("_copy")
    )
    if approximate:
        hits, _ = descend(few, k, metric)
    else:
        pivots = _pivots(few)
        blocks = _blocks(few, pivots, metric, k=k)
        pairs = _block_pairs(blocks, blocks, pivots, metric)
        hits = _ranked(_score_blocks(_tiles(pairs, blocks, blocks), k, metric, False), k)
    if seen.get["copies"] == 0:
        return hits
    hits = materialize(hits)
    leaders = rows.groupBy("grp", "vec").agg(F.min("id").alias("leader"))
    lookup = rows.join(leaders, ["grp", "vec"]).select(F.col("id").alias("query_id"), "leader")
    return lookup.join(hits.withColumnRenamed("query_id", "leader"), "leader").select(
        "query_id", "id", "score", "rank"
    )


def similar_pairs(
    df: DataFrame,
    threshold: float,
    id_col: str = "id",
    vec_col: str = "embedding",
    group: str | None = None,
) -> DataFrame:
    """All pairs ``(a, b, similarity)``, ``a < b``, of cosine ``>= threshold`` (in a group)."""
    rows = _prepared(df, id_col, vec_col, "cosine", group)
    pivots = _pivots(rows)
    blocks = _blocks(rows, pivots, "cosine", floor=threshold)
    pairs = _block_pairs(blocks, blocks, pivots, "cosine").filter(
        F.col("left_block") <= F.col("right_block")
    )
    scored = _score_blocks(_tiles(pairs, blocks, blocks), None, "cosine", True)
    return scored.select(
        F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity")
    )
