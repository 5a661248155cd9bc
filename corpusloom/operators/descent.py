"""Approximate neighbours: a graph improved by joining the neighbours of neighbours.

Rows start with the nearest of a few small leaves (runs of rows on the same sides of random
planes). Each round gathers, for every node, its neighbours and the rows it is a neighbour of,
compares those among which at least one edge is fresh, and keeps the best ``k`` of each row. Work
per round is in proportion to the rows, and falls as fewer edges are fresh.

The list of a hub, a row that very many others point to, is split into parts of bounded size, each
joined with the hub's own neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import dot
from corpusloom.runtime import materialize

LEAF = 128
TREES = 3
ROUNDS = 8
#: Shortest list that descends; a longer list than asked for finds more.
POOL = 32
_DONE = 0.002  # share of fresh edges at which a round no longer pays
_PLANES = 20
_SENT_HUBS = 1 << 20
_DECIMALS = 6


def _score_matrix(x: np.ndarray, metric: str) -> np.ndarray:
    products = x @ x.T
    if metric == "cosine":
        return np.round(products, _DECIMALS)
    squares = (x**2).sum(1)
    return np.round(-np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * products, 0.0)), _DECIMALS)


def _planes(rows: DataFrame, seed: int) -> np.ndarray:
    """Planes half way between pairs of rows drawn by hash: a fixed number, one row each."""
    drawn = [r.vec for r in rows.orderBy(F.xxhash64(F.lit(seed), "id")).limit(2 * _PLANES).select("vec").collect()]
    x = np.array(drawn[: len(drawn) // 2 * 2], float)
    a, b = x[0::2], x[1::2]
    return np.hstack([a - b, (((b**2) - (a**2)).sum(1) / 2)[:, None]])


def _leaf_graph(rows: DataFrame, k: int, metric: str, leaf: int, seed: int, seen: Observation) -> DataFrame:
    """``(src, dst, score)``: the best of each row inside its leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(_planes(rows, seed))

    @F.pandas_udf("long")
    def side(vectors: pd.Series) -> pd.Series:
        planes = shared.value
        x = np.vstack(vectors)
        above = x @ planes[:, :-1].T + planes[:, -1] > 0
        return pd.Series(above @ (1 << np.arange(above.shape[1])[::-1]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, run in batch.groupby("grp", sort=False):
                ids, x = run["id"].to_numpy(), np.vstack(run["vec"])
                for at in range(0, len(run), leaf):
                    own, part = ids[at : at + leaf], x[at : at + leaf]
                    yield _best_of(own, _score_matrix(part, metric), k, len(part) ** 2)

    order = ["grp", "_side", F.xxhash64("id")]
    laid = rows.withColumn("_side", side("vec")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = laid.mapInPandas(compare, "src long, dst long, score double, compared long")
    return found.observe(seen, F.sum("compared").alias("n")).drop("compared")


def _best_of(ids: np.ndarray, scores: np.ndarray, k: int, compared: int) -> pd.DataFrame:
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), order.shape[1])
    cols = order.ravel()
    counted = np.zeros(len(rows), np.int64)
    counted[:1] = compared
    return pd.DataFrame({"src": ids[rows], "dst": ids[cols], "score": scores[rows, cols], "compared": counted})


def _top(edges: DataFrame, k: int) -> DataFrame:
    """One edge a pair (known ones are not fresh again), the ``k`` best of each row."""
    merged = edges.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meetings(graph: DataFrame, k: int) -> DataFrame:
    """``(node, part, members)``: who is compared at each node, hubs in parts of about 2k rows."""
    hubs = materialize(
        graph.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * k)
        .select("node", F.ceil(F.col("n") / (2 * k)).cast("int").alias("parts"))
    )
    sent = F.broadcast(hubs) if hubs.count() <= _SENT_HUBS else hubs
    parts = F.coalesce("parts", F.lit(1))
    ahead = graph.select(F.col("src").alias("node"), F.col("dst").alias("member"), "fresh").join(sent, "node", "left").select(
        "node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "member", "fresh"
    )
    behind = graph.select(F.col("dst").alias("node"), F.col("src").alias("member"), "fresh").join(sent, "node", "left").select(
        "node", F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"), "member", "fresh"
    )
    lively = graph.where("fresh").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    both = ahead.unionByName(behind).join(lively, "node", "left_semi")
    return both.groupBy("node", "part", "member").agg(F.max("fresh").alias("fresh"))


def _compare_members(k: int, metric: str):
    """Arrow function: one matrix product a meeting; edges that enter the list of a row."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            ids, fresh, floor = (
                pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in ("member", "fresh", "floor")
            )
            x = pc.struct_field(flat, "vec").flatten().to_numpy().reshape(len(flat), -1)
            ends = np.cumsum([0, *pc.list_value_length(members).to_pylist()])
            src, dst, score, compared = [], [], [], 0
            for a, z in zip(ends[:-1], ends[1:]):
                s = _score_matrix(x[a:z], metric)
                new = fresh[a:z]
                wanted = (new[:, None] | new[None]) & (s >= floor[a:z, None])
                np.fill_diagonal(wanted, False)
                compared += int((new[:, None] | new[None]).sum())
                if z - a > k:  # no row needs more than k from one meeting
                    kept = np.where(wanted, s, -np.inf)
                    wanted &= kept >= np.partition(kept, z - a - k, axis=1)[:, z - a - k, None]
                rows, cols = np.nonzero(wanted)
                src.append(ids[a:z][rows])
                dst.append(ids[a:z][cols])
                score.append(s[rows, cols])
            src, dst, score = (np.concatenate(v) if v else np.empty(0) for v in (src, dst, score))
            counted = np.zeros(len(src), np.int64)
            counted[:1] = compared
            columns = [
                pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64)), pa.array(score.astype(float)), pa.array(counted),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "score", "compared"])

    return compare


def descend(
    rows: DataFrame, k: int, metric: str, rounds: int = ROUNDS, leaf: int = LEAF, trees: int = TREES, pool: int | None = None
) -> tuple[DataFrame, int]:
    """Neighbour lists ``(query_id, id, score, rank)`` of ``rows(grp, id, vec)``, and comparisons made.

    Every row has itself and ``k - 1`` others, if its group has as many. Lists of ``pool`` rows
    descend, the best ``k`` of them are given. Lists are close to the exact ones but not always equal; they depend on the rows alone, not on their partitions, up
    to the borders of leaves.
    """
    asked, k = k, max(pool or POOL, k)
    rows = materialize(rows)
    if rows.isEmpty():
        none = rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return none.limit(0), 0
    leaf, compared = max(leaf, 2 * k), 0
    start = None
    for tree in range(trees):
        seen = Observation()
        grown = materialize(_leaf_graph(rows, k, metric, leaf, tree, seen))
        compared += seen.get["n"] or 0
        start = grown if start is None else start.unionByName(grown)
    graph = materialize(_top(start.withColumn("fresh", F.lit(True)), k))
    n_edges = graph.count()
    for _ in range(rounds):
        floors = graph.groupBy("src").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor")
        )
        held = rows.select(F.col("id").alias("member"), "vec").join(
            floors.withColumnRenamed("src", "member"), "member"
        )
        meetings = (
            _meetings(graph, k).join(held, "member")
            .groupBy("node", "part")
            .agg(F.collect_list(F.struct("member", "fresh", "floor", "vec")).alias("members"))
            .select("members")
        )
        seen = Observation()
        found = materialize(
            meetings.mapInArrow(_compare_members(k, metric), "src long, dst long, score double, compared long")
            .observe(seen, F.sum("compared").alias("n"))
            .drop("compared")
        )
        compared += seen.get["n"] or 0
        known = graph.select("src", "dst", "score", F.lit(False).alias("fresh"))
        changed = Observation()
        graph = materialize(
            _top(known.unionByName(found.distinct().withColumn("fresh", F.lit(True))), k).observe(
                changed, F.count_if("fresh").alias("fresh")
            )
        )
        if changed.get["fresh"] <= _DONE * n_edges:
            break
    lists = graph.where(F.col("rank") <= asked)
    return lists.select(F.col("src").alias("query_id"), F.col("dst").alias("id"), "score", "rank"), compared


# --- search over the graph -----------------------------------------------------------


def walk(
    queries: DataFrame,
    corpus: DataFrame,
    graph: DataFrame,
    k: int,
    metric: str,
    beam: int | None = None,
    entries: int = 512,
    rounds: int = 12,
) -> DataFrame:
    """Approximate ``(query_id, id, score, rank)`` of ``queries(query_id, vec)``: best-first walks.

    Every query starts at the best of ``entries`` rows drawn by hash, follows the edges
    ``graph(src, dst)`` of the best ``beam`` rows it has met, and stops when none of them is new.
    All queries walk at once; a round is a join with the graph and one with the vectors met.
    """
    beam = beam or max(4 * k, 32)
    links = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = materialize(links)

    def scored(pairs: DataFrame) -> DataFrame:
        q = queries.select("query_id", F.col("vec").alias("_q"))
        met = pairs.join(corpus.select("id", "vec"), "id").join(q, "query_id")
        if metric == "cosine":
            score = dot(F.col("_q"), F.col("vec"))
        else:
            gap = F.zip_with("_q", "vec", lambda a, b: a - b)
            score = -F.sqrt(dot(gap, gap))
        return met.select("query_id", "id", F.round(score, _DECIMALS).alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best(met: DataFrame) -> DataFrame:
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam)

    doors = corpus.orderBy(F.xxhash64(F.lit(beam), "id")).limit(entries).select("id")
    first = queries.select("query_id").join(F.broadcast(doors))  # a fixed number of rows for each query
    state = materialize(best(scored(first)).withColumn("open", F.lit(True)))
    for _ in range(rounds):
        ahead = state.where("open").select("query_id", F.col("id").alias("src")).join(links, "src").select(
            "query_id", F.col("dst").alias("id")
        ).distinct().join(state.select("query_id", "id"), ["query_id", "id"], "left_anti")
        met = scored(ahead).withColumn("open", F.lit(True))
        seen = Observation()
        state = materialize(
            best(state.drop("rank").withColumn("open", F.lit(False)).unionByName(met))
            .observe(seen, F.count_if("open").alias("open"))
        )
        if not seen.get["open"]:
            break
    return state.where(F.col("rank") <= k).drop("open")
