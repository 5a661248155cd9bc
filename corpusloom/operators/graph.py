"""Neighbour graphs, layouts and the point and edge tables behind a map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.embeddings import pca_project
from corpusloom.operators.ordering import with_row_ids
from corpusloom.operators.similarity import neighbours
from corpusloom.runtime import materialize, materialize_counted

_STEPS = 64
_TOLERANCE = 1e-5
_MIN_SCALE = 1e-3
_BLOCK_NODES = 1 << 16


def knn_graph(
    df: DataFrame,
    k: int = 50,
    id_col: str = "id",
    vec: str = "embedding",
    metric: str = "cosine",
    group: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``(src, dst, distance, rank)``: the k nearest rows, the row itself among them."""
    near = neighbours(df, k, id_col, vec, metric, group, approximate)
    distance = F.lit(1.0) - F.col("score") if metric == "cosine" else -F.col("score")
    return near.select(
        F.col("query_id").alias("src"),
        F.col("id").alias("dst"),
        F.round(F.greatest(distance, F.lit(0.0)), 6).alias("distance"),
        "rank",
    )


def _bandwidth(distances: Column, rho: Column, target: float) -> Column:
    """Bisect the scale at which the neighbour weights sum to ``target``."""

    def weight(scale: Column) -> Column:
        return F.aggregate(
            distances,
            F.lit(0.0),
            lambda total, d: total + F.when(d > rho, F.exp(-(d - rho) / scale)).otherwise(F.lit(1.0)),
        )

    def state(low, high, mid, done):
        return F.struct(low.alias("low"), high.alias("high"), mid.alias("mid"), done.alias("done"))

    unbounded = F.lit(float("inf"))

    def step(s: Column, _: Column) -> Column:
        # bind the weight of the current scale once
        return F.transform(F.array(F.when(s["done"], F.lit(target)).otherwise(weight(s["mid"]))), lambda w: move(s, w))[0]

    def move(s: Column, w: Column) -> Column:
        settled = s["done"] | (F.abs(w - target) < _TOLERANCE)
        above = w > target
        halved_down = (s["low"] + s["mid"]) / 2
        halved_up = F.when(s["high"] == unbounded, s["mid"] * 2).otherwise((s["mid"] + s["high"]) / 2)
        return state(
            F.when(settled | above, s["low"]).otherwise(s["mid"]),
            F.when(~settled & above, s["mid"]).otherwise(s["high"]),
            F.when(settled, s["mid"]).when(above, halved_down).otherwise(halved_up),
            settled,
        )

    start = state(F.lit(0.0), unbounded, F.lit(1.0), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step)["mid"]


def fuzzy_graph(knn: DataFrame, k: int) -> DataFrame:
    """Weighted undirected edges ``(src, dst, weight)``, ``src < dst``.

    Each point scales its distances past the nearest one so that the weights of its k-1
    neighbours add up to log2(k); the two directions of an edge combine as ``a + b - ab``.
    """
    points = knn.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "dst"))).alias("near")
    )
    mean_all = knn.agg(F.avg("distance")).scalar()
    lengths = F.transform("near", lambda e: e["distance"])
    points = points.withColumn("d", lengths).withColumn(
        "rho", F.coalesce(F.array_min(F.filter("d", lambda d: d > 0)), F.lit(0.0))
    )
    sigma = _bandwidth(F.slice("d", 2, k), F.col("rho"), float(np.log2(k)))
    mean_own = F.aggregate("d", F.lit(0.0), lambda t, d: t + d) / F.size("d")
    least = F.lit(_MIN_SCALE) * F.when(F.col("rho") > 0, mean_own).otherwise(mean_all)
    scaled = points.withColumn("sigma", F.greatest(sigma, least)).select(
        "src", "rho", "sigma", F.explode("near").alias("e")
    )
    past = F.col("e.distance") - F.col("rho")
    directed = scaled.filter(F.col("src") != F.col("e.dst")).select(
        "src",
        F.col("e.dst").alias("dst"),
        F.when((past <= 0) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(F.exp(-past / F.col("sigma"))).alias("w"),
    )
    forward = F.max(F.when(F.col("src") < F.col("dst"), F.col("w")))
    backward = F.max(F.when(F.col("src") > F.col("dst"), F.col("w")))
    return (
        directed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.coalesce(forward, F.lit(0.0)).alias("f"), F.coalesce(backward, F.lit(0.0)).alias("r"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("f") + F.col("r") - F.col("f") * F.col("r")).alias("weight"))
        .filter(F.col("weight") > 0)
    )


# --- layouts -------------------------------------------------------------------------


def _axes(coords: str, k: int) -> list[Column]:
    return [F.get(coords, F.lit(i)).alias("xyz"[i]) for i in range(k)]


def layout(df: DataFrame, k: int = 2, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Coordinates ``(id, x, y[, z])`` from the first principal components."""
    return pca_project(df.select(id_col, vec), k, vec, name="coords").select(id_col, *_axes("coords", k))


def spectral_layout(
    edges: DataFrame, k: int = 2, tolerance: float = 1e-5, depth: int = 4, restarts: int = 40
) -> DataFrame:
    """Coordinates ``(id, x, y[, z])`` from the leading eigenvectors of the normalised graph.

    Block Krylov iteration: a few vectors are spread over the graph ``depth`` times, the best
    combinations of all that is met become the next start, until ``W v - t v`` is shorter than
    ``tolerance`` for every axis (``restarts`` bounds the search). Nodes are numbered once, and a
    spreading joins blocks of links to blocks of vectors; only the small Gram matrix visits the
    driver.

    Axes have unit length, their largest entry is positive, and the trivial axis (the root of the
    degree) is left out. In a graph of several parts the first axes tell parts from each other;
    axes of equal eigenvalue are one choice among their rotations.
    """
    m = k + 4  # more vectors than needed speed the others up
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    degree = both.groupBy("src").agg(F.sum("weight").alias("deg"))
    nodes, n = materialize_counted(with_row_ids(degree, ["src"], "at"))
    size = min(_BLOCK_NODES, max(1024, n // edges.sparkSession.sparkContext.defaultParallelism))
    links = _packed_links(both, nodes, size)
    noise = lambda j: (F.xxhash64(F.lit(j), F.col("src")) % 1_000_003).cast("double") / 1_000_003
    rows = nodes.select((F.col("at") / size).cast("int").alias("block"), "at", F.array(F.sqrt("deg"), *[noise(j) for j in range(m)]).alias("row"))
    block = materialize(rows.groupBy("block").applyInArrow(_pack_rows, _STATE))
    for _ in range(restarts):
        met = block
        for _ in range(depth):
            met = materialize(_spread(links, met, m))
        gram = _gram(met, m * (depth + 1) + 1)
        # everything is taken at right angles to the trivial axis
        along = gram[0, 1:] / gram[0, 0] if gram[0, 0] else gram[0, 1:]
        mix, off = _best_mix(gram[1:, 1:] - np.outer(gram[0, 1:], along), m, 1e-13 * np.diag(gram)[1:])
        m = mix.shape[1]  # a small graph has fewer directions
        block = materialize(_mixed(met, np.vstack([-along[: len(mix)] @ mix, mix])))
        if not m or (off[:k] <= tolerance).all():  # the test is good to about 8 digits
            break
    placed = materialize(_rows_of(block, m, size))
    top = placed.agg(*[F.struct(F.max(f"v{j}"), F.min(f"v{j}")).alias(f"v{j}") for j in range(m)]).first() if m else ()
    sign = [1.0 if hi is None or hi >= -lo else -1.0 for hi, lo in top]
    axes = [(F.col(f"v{j}") * sign[j] if j < m else F.lit(0.0)).alias("xyz"[j]) for j in range(k)]
    return nodes.select(F.col("src").alias("id"), "at").join(placed, "at").select("id", *axes)


# A block holds the vectors of consecutive nodes as one matrix: those met before (the root of the
# degree first) and the last ones.
_STATE = "block int, n int, met binary, last binary"


def _floats(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=float).reshape(n, len(data) // (8 * n))


def _packed_links(both: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(src_block, dst_block, src, dst, w)``: the normalised links between two blocks as arrays, by ``src``."""
    ends = [nodes.select(F.col("src").alias(e), F.col("deg").alias(f"deg_{e}"), F.col("at").alias(f"at_{e}")) for e in ("src", "dst")]
    weighed = both.join(ends[0], "src").join(ends[1], "dst").select(
        *[(F.col(f"at_{e}") / size).cast("int").alias(f"{e}_block") for e in ("src", "dst")],
        *[(F.col(f"at_{e}") % size).cast("int").alias(e) for e in ("src", "dst")],
        (F.col("weight") / F.sqrt(F.col("deg_src") * F.col("deg_dst"))).alias("w"),
    )

    def pack(links: pa.Table) -> pa.Table:
        links = links.sort_by([("src", "ascending"), ("dst", "ascending")])
        arrays = {c: [links[c].to_numpy().tobytes()] for c in ("src", "dst", "w")}
        return pa.table({"src_block": links["src_block"][:1], "dst_block": links["dst_block"][:1]} | arrays)

    schema = "src_block int, dst_block int, src binary, dst binary, w binary"
    return materialize(weighed.groupBy("src_block", "dst_block").applyInArrow(pack, schema))


def _state_row(block: int, met: np.ndarray, last: np.ndarray) -> pa.Table:
    return pa.table({
        "block": pa.array([block], pa.int32()), "n": pa.array([len(met)], pa.int32()), "met": [met.tobytes()], "last": [last.tobytes()],
    })


def _pack_rows(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    matrix = np.stack(rows["row"].to_numpy())
    return _state_row(rows["block"][0].as_py(), matrix[:, :1], matrix[:, 1:])


def _mixed(met: DataFrame, mix: np.ndarray) -> DataFrame:
    """The start of the next round: combinations of the root of the degree and all but the last vectors."""

    def start(batches):
        for batch in batches:
            for r in batch.to_pylist():
                held = _floats(r["met"], r["n"])
                yield from _state_row(r["block"], held[:, :1].copy(), held[:, : len(mix)] @ mix).to_batches()

    return met.mapInArrow(start, _STATE)


def _rows_of(block: DataFrame, m: int, size: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                last = np.frombuffer(r["last"], dtype=float).reshape(r["n"], m)
                at = pa.array(r["block"] * size + np.arange(r["n"]), pa.int64())
                yield pa.RecordBatch.from_arrays([at, *map(pa.array, last.T.copy())], names=["at", *[f"v{j}" for j in range(m)]])

    return block.mapInArrow(rows, ", ".join(["at long", *[f"v{j} double" for j in range(m)]]))


def _gram(met: DataFrame, width: int) -> np.ndarray:
    """Inner products of all vectors met."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for r in batch.to_pylist():
                x = np.hstack([_floats(r["met"], r["n"]), _floats(r["last"], r["n"])])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    parts = met.coalesce(4 * met.sparkSession.sparkContext.defaultParallelism).mapInArrow(products, "sums binary").collect()
    return sum((np.frombuffer(p.sums).reshape(width, width) for p in parts), np.zeros((width, width)))


def _best_mix(gram: np.ndarray, m: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the leading vectors over the columns, and how far each is from an eigenvector.

    Column ``i + m`` is column ``i`` after one more spreading. Columns whose square is at most
    ``least`` hold rounding errors only.
    """
    q = len(gram) - m
    length = np.maximum(np.diag(gram), 0.0)
    spent = length <= least
    scale = np.where(spent, 0.0, 1 / np.sqrt(np.where(spent, 1.0, length)))
    inner = gram[:q, :q] * np.outer(scale[:q], scale[:q])
    spread = gram[:q, m:] * scale[:q, None] * scale[None, :q]
    size, turn = np.linalg.eigh((inner + inner.T) / 2)
    kept = size > max(size.max() * 1e-12, 1e-300)
    basis = turn[:, kept] / np.sqrt(size[kept])
    value, vector = np.linalg.eigh(basis.T @ ((spread + spread.T) / 2) @ basis)
    order = np.argsort(-value)[:m]
    mix = scale[:q, None] * (basis @ vector[:, order])
    gap = np.zeros((len(gram), mix.shape[1]))
    gap[m:] += mix
    gap[:q] -= mix * value[order]
    return mix, np.sqrt(np.maximum((gap * (gram @ gap)).sum(0), 0.0))


def _spread(links: DataFrame, state: DataFrame, m: int) -> DataFrame:
    """Half a step of diffusion: ``(W + I) / 2`` applied to the last vectors, which join those met."""
    schema = f"{_STATE}, rows binary, moved binary"

    def move(batches):
        for batch in batches:
            for r in batch.to_pylist():
                src, dst = np.frombuffer(r["src"], np.int32), np.frombuffer(r["dst"], np.int32)
                parts = np.frombuffer(r["w"])[:, None] * _floats(r["last"], r["n"])[dst]
                starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["src_block"]], pa.int32()), pa.array([None], pa.int32()), *[pa.array([None], pa.binary())] * 2,
                     pa.array([src[starts].tobytes()]), pa.array([np.add.reduceat(parts, starts).tobytes()])],
                    names=["block", "n", "met", "last", "rows", "moved"],
                )

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["n"] is not None)
        met, last = _floats(own["met"], own["n"]), _floats(own["last"], own["n"])
        total = last.copy()
        for r in rows:
            if r["n"] is None:
                total[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["moved"]).reshape(-1, m)
        return _state_row(own["block"], np.hstack([met, last]), total / 2)

    moved = links.join(state.select(F.col("block").alias("dst_block"), "n", "last"), "dst_block").mapInArrow(move, schema)
    own = state.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("rows", "moved")])
    return moved.unionByName(own).groupBy("block").applyInArrow(add, _STATE)


# --- point and edge tables -----------------------------------------------------------


def edge_table(edges: DataFrame, coords: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with the coordinates of both ends, in as many dimensions as ``coords`` has."""
    axes = [a for a in ("x", "y", "z") if a in coords.columns]
    start = coords.select(F.col(id_col).alias("src"), *[F.col(a).alias(f"{a}0") for a in axes])
    end = coords.select(F.col(id_col).alias("dst"), *[F.col(a).alias(f"{a}1") for a in axes])
    ends = [f"{a}{k}" for k in (0, 1) for a in axes]
    return edges.join(start, "src").join(end, "dst").select("src", "dst", *ends, "weight")


def align_pad(
    vectors: DataFrame, texts: DataFrame, chapter: str = "chapter", idx: str = "idx"
) -> DataFrame:
    """Give every vector row its sentence, character and place by ``(chapter, idx)``.

    Surplus texts are dropped; missing ones become a numbered placeholder that restarts at 0
    after the last text, and ``unknown`` labels.
    """
    present = texts.groupBy(chapter).agg(F.count(F.lit(1)).alias("_present"))
    missing_no = F.col(idx) - F.coalesce("_present", F.lit(0))
    placeholder = F.concat(
        F.lit("Sentence "), missing_no.cast("string"), F.lit(" from Chapter "), F.col(chapter).cast("string")
    )
    found = texts.withColumn("_found", F.lit(True))
    joined = vectors.join(found, [chapter, idx], "left").join(present, chapter, "left")
    filled = {"sentence": placeholder, "character": F.lit("unknown"), "place": F.lit("unknown")}
    for name, default in filled.items():
        if name in texts.columns:
            joined = joined.withColumn(name, F.when(F.col("_found"), F.col(name)).otherwise(default))
    return joined.drop("_found", "_present")


def length_mismatch(vectors: DataFrame, texts: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Chapters whose number of vectors and texts differ: ``(chapter, n_vectors, n_texts)``."""
    a = vectors.groupBy(chapter).agg(F.count(F.lit(1)).alias("n_vectors"))
    b = texts.groupBy(chapter).agg(F.count(F.lit(1)).alias("n_texts"))
    return (
        a.join(b, chapter, "full")
        .select(chapter, F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
        .filter(F.col("n_vectors") != F.col("n_texts"))
    )


def point_table(points: DataFrame, width: int = 100) -> DataFrame:
    """Add ``character_label``, ``place_label`` and ``hover_text`` to an aligned point table."""
    return (
        points.withColumn("character_label", X.first_item(F.col("character")))
        .withColumn("place_label", X.first_item(F.col("place")))
        .withColumn("hover_text", X.shorten(F.col("sentence"), width))
    )
