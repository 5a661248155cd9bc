"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf. The tree of a source is cut into aligned subtrees of ``HEIGHT`` levels; a
block keeps all nodes of one subtree in one byte string, ordered by splitting the levels at half
height again and again, so that any path from leaf to root stays within few neighbouring stretches
at every scale. Where a node stands is arithmetic on its level and index; the same arithmetic
serves construction and the retrieval of siblings. Block roots are the leaves of the next round of
blocks, until one block holds the top of a source; the roots of the sources form one more tree.
Proofs are read from the top down: a block learns the path above its root, then adds its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import with_row_ids, with_running_total
from corpusloom.runtime import materialize, materialize_counted

FAN = 3
HEIGHT = 6
_DIGEST = 32
_SENT_SOURCES = 1 << 17


# --- address arithmetic --------------------------------------------------------------


def node_count(height: int) -> int:
    """Nodes of a complete tree."""
    return (FAN ** (height + 1) - 1) // (FAN - 1)


def address(height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` of a level (0 is the root) in van Emde Boas order.

    The upper half of the levels comes first, then the subtrees below it from left to right,
    each laid out the same way.
    """
    index = np.asarray(index, np.int64)
    if height == 0:
        return np.zeros_like(index)
    upper = (height + 1) // 2
    if level < upper:
        return address(upper - 1, level, index)
    below = height - upper
    tree, inner = np.divmod(index, FAN ** (level - upper))
    return node_count(upper - 1) + tree * node_count(below) + address(below, level - upper, inner)


@functools.lru_cache(maxsize=64)
def _level_addresses(height: int, level: int) -> list[int]:
    return address(height, level, np.arange(FAN**level)).tolist()


def level_sizes(n: int, height: int) -> list[int]:
    """Nodes present at each level, root first, above ``n`` leaves."""
    sizes = [n]
    for _ in range(height):
        sizes.append(-(-sizes[-1] // FAN))
    return sizes[::-1]


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def hashed(parts: str) -> str:
    """Digest (hex) of digests written one after the other as hex."""
    return sha256(parts.encode()).hexdigest()


# --- one block -----------------------------------------------------------------------


def lay_out(leaves: list[bytes], height: int) -> bytes:
    """All nodes over ``leaves`` in van Emde Boas order; places without a node are zero."""
    nodes = bytearray(node_count(height) * _DIGEST)
    row = [d.hex() for d in leaves]
    for level in range(height, -1, -1):
        for at, digest in zip(_level_addresses(height, level), row):
            nodes[at * _DIGEST : (at + 1) * _DIGEST] = bytes.fromhex(digest)
        row = [hashed("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
    return bytes(nodes)


def paths(layout: bytes, n: int, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf, level by level up to the block's root: siblings to the left and right, as hex."""
    sizes = level_sizes(n, height)
    steps: list[list[tuple[str, str]]] = []
    for level in range(height, 0, -1):
        places = _level_addresses(height, level)
        digest = [layout[a * _DIGEST : (a + 1) * _DIGEST].hex() for a in places[: sizes[level]]]
        row = []
        for i in range(len(digest)):
            first = i - i % FAN
            row.append(("".join(digest[first:i]), "".join(digest[i + 1 : first + FAN])))
        steps.append(row)
    return [[row[leaf // FAN**k] for k, row in enumerate(steps)] for leaf in range(n)]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """Root over a leaf with the given siblings."""
    for left, right in path:
        digest = hashed(left + digest + right)
    return digest


def _said(path: list[tuple[str, str]]) -> str:
    return "".join(f"{left},{right};" for left, right in path)


def _heard(text: str) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in text.split(";")[:-1]]


# --- rounds of blocks ----------------------------------------------------------------


def _block_height(n: int, height: int) -> int:
    """Levels in the blocks of a tree with ``n`` leaves: all trees of one block end at their root."""
    return min(height, height_of(n))


def _grown(height: int):
    """Arrow function: add the layout and the root to blocks with their members."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = []
            for n, digests in _digests(batch, "digest"):
                layouts.append(lay_out(digests, _block_height(n, height)))
            roots = [nodes[:_DIGEST] for nodes in layouts]
            columns = [*batch.columns, pa.array(layouts, pa.binary()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "layout", "root"])

    return grow


def _digests(batch: pa.RecordBatch, field: str) -> Iterator[tuple[int, list[bytes]]]:
    """Number of leaves of the tree and one field of the members, for each block."""
    members = batch.column("members")
    values = pc.struct_field(members.flatten(), field).to_pylist()
    ends = np.cumsum([0, *pc.list_value_length(members).to_pylist()]).tolist()
    for n, a, z in zip(batch.column("n").to_pylist(), ends[:-1], ends[1:]):
        yield n, values[a:z]


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks ``(tree, block, n, members, layout, root)`` of ``nodes(tree, idx, n, digest, ...)``.

    ``n`` counts the leaves of the whole tree. A block has at most ``FAN**height`` members.
    """
    width = FAN**height
    kept = [c for c in nodes.columns if c not in ("tree", "n")]
    grouped = (
        nodes.withColumn("block", F.floor(F.col("idx") / width))
        .groupBy("tree", "block", "n")
        .agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("members"))
    )
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return materialize(grouped.mapInArrow(_grown(height), f"{kind}, layout binary, root binary"))


def forest(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks, lowest first, and ``(tree, root)``."""
    width = FAN**height
    rounds, roots = [], None
    while True:
        blocks = blocks_of(nodes, height)
        rounds.append(blocks)
        top = blocks.where(F.col("n") <= width).select("tree", "root")
        roots = top if roots is None else roots.unionByName(top)
        lower = blocks.where(F.col("n") > width)
        if lower.isEmpty():
            return rounds, roots
        nodes = lower.select(
            "tree",
            F.col("block").alias("idx"),
            F.ceil(F.col("n") / width).alias("n"),
            F.col("root").alias("digest"),
        )


def _paths_down(height: int):
    """Arrow function: path of every member of the blocks, given the path above each block."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, idx, path = [], [], []
            rows = zip(
                batch.column("tree").to_pylist(), batch.column("above").to_pylist(),
                batch.column("layout").to_pylist(), _digests(batch, "idx"),
            )
            for t, above, layout, (n, members) in rows:
                own = paths(layout, len(members), _block_height(n, height))
                tree += [t] * len(members)
                idx += members
                path += [_said(p) + above for p in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int64()), pa.array(idx, pa.int64()), pa.array(path, pa.string())],
                ["tree", "idx", "path"],
            )

    return down


def with_paths_above(rounds: list[DataFrame], height: int, crown: DataFrame, send) -> DataFrame:
    """The lowest blocks with ``above``, the path from the block's root to the end.

    ``crown(tree, above, ...)`` continues from the root of each tree.
    """
    upper = None
    for blocks in reversed(rounds):
        held = blocks.join(send(crown), "tree")
        if upper is not None:
            beneath = upper.select("tree", F.col("idx").alias("block"), F.col("path").alias("_path"))
            held = held.join(beneath, ["tree", "block"], "left").withColumn("above", F.coalesce("_path", "above")).drop("_path")
        if blocks is rounds[0]:
            return held
        upper = materialize(
            held.select("tree", "n", "members", "layout", "above").mapInArrow(
                _paths_down(height), "tree long, idx long, path string"
            )
        )
    raise AssertionError


# --- manifest ------------------------------------------------------------------------


def field_text(*columns: Column) -> Column:
    """Fields written one after the other: ``-`` for null, else byte count, ``:`` and value."""
    said = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in said])


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(field_text(*columns), 256))


def _verified(height: int):
    """Arrow function: leaf, proof and folded root of every member of the lowest blocks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members").flatten()
            leaf, proof, folded, subroot, root = [], [], [], [], []
            rows = zip(
                batch.column("above").to_pylist(), batch.column("layout").to_pylist(),
                batch.column("subroot").to_pylist(), batch.column("top").to_pylist(),
                _digests(batch, "digest"), _digests(batch, "found"),
            )
            for above, layout, sub, top, (n, digests), (_, found) in rows:
                rest = _heard(above)
                rest_said = "".join(left + right for left, right in rest)
                own = paths(layout, len(digests), _block_height(n, height))
                for path, digest, now in zip(own, digests, found, strict=True):
                    leaf.append(digest.hex())
                    proof.append(hashed("".join(left + right for left, right in path) + rest_said))
                    folded.append(fold(fold(now.hex(), path), rest))
                subroot += [sub.hex()] * len(digests)
                root += [top.hex()] * len(digests)
            ids = pc.struct_field(members, "doc_id")
            said = [pa.array(c, pa.string()) for c in (leaf, subroot, root, proof, folded)]
            yield pa.RecordBatch.from_arrays(
                [ids, *said], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            )

    return check


def manifest(
    docs: DataFrame,
    found: Column | None = None,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    height: int = HEIGHT,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` make the leaf. ``found`` is the digest of the row as it is met now (default: as
    recorded); it is folded with the recorded siblings and verified against the root. Leaves of a
    group ascend by key; null keys come last, rows that share a key stand in order of their
    digests. A null group is a group of its own and comes first. Null fields are told apart from
    empty ones. A single document is its own subroot, a single group's subroot the root. An empty
    table gives no rows. Columns besides ``fields``, key and group are ignored.
    """
    digest = leaf_digest(*[F.col(c) for c in fields])
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"), F.col(group).alias("source"), digest.alias("digest"),
            (digest if found is None else F.coalesce(found, digest)).alias("found"),
        )
    )
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    numbered = with_row_ids(counted, [F.col("source").isNotNull(), "source"], "tree")
    trees, many = materialize_counted(with_running_total(numbered, ["tree"], "n", "start"))
    send = F.broadcast if many <= _SENT_SOURCES else (lambda df: df)

    named = trees.select(F.col("source").alias("_s"), "tree", "n", "start")
    placed = rows.join(send(named), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    order = ["tree", F.col("doc_id").isNull(), "doc_id", "digest", "found"]
    leaves = with_row_ids(placed, order, "_at").select(
        "tree", (F.col("_at") - F.col("start")).alias("idx"), "n", "digest", "found", "doc_id"
    )
    rounds, subroots = forest(leaves, height)
    subroots = materialize(subroots)

    one = F.lit(0).cast("long")
    crown_nodes = subroots.select(
        one.alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), F.col("root").alias("digest")
    )
    crown_rounds, roots = forest(crown_nodes, height)
    ends = roots.select("tree", F.lit("").alias("above"), F.col("root").alias("top"))
    crown_blocks = with_paths_above(crown_rounds, height, ends, F.broadcast)
    crown_paths = crown_blocks.select("tree", "n", "members", "layout", "above").mapInArrow(
        _paths_down(height), "tree long, idx long, path string"
    )
    crown = materialize(
        crown_paths.select(F.col("idx").alias("tree"), F.col("path").alias("above"))
        .join(subroots.withColumnRenamed("root", "subroot"), "tree")
        .withColumn("top", roots.select("root").scalar())
    )
    lowest = with_paths_above(rounds, height, crown, send)
    kind = docs.schema[key].dataType.simpleString()
    checked = lowest.select("n", "members", "layout", "above", "subroot", "top").mapInArrow(
        _verified(height),
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
