"""Manifest against plain level-by-level hashing, and the storage order on its own."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle_manifest
from corpusloom.llm.merkle_manifest import address, lay_out, manifest, node_count, paths
from corpusloom.llm.queries import LEAF, remainder


def h(text):
    return sha256(text.encode()).hexdigest()


def said(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plainly(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to rows of the result."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def climb(row, spot):
        """Siblings of one node on the way up, and the top."""
        path = []
        while len(row) > 1:
            a = spot - spot % 3
            path.append((row[a:spot], row[spot + 1 : a + 3]))
            row = [h("".join(row[i : i + 3])) for i in range(0, len(row), 3)]
            spot //= 3
        return path, row[0]

    leaves = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is None, r[0] or 0, said(*r)))
        leaves[s] = [said(*r) for r in groups[s]]
    subroots = [climb(leaves[s], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        for i, row in enumerate(groups[s]):
            low, subroot = climb(leaves[s], i)
            high, root = climb(subroots, k)
            met = leaves[s][i]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                met = said(*row[:4], row[4].replace("\n", ""))
            for left, right in low + high:
                met = h("".join(left) + met + "".join(right))
            proof = h("".join("".join(left + right) for left, right in low + high))
            out.append((row[0], leaves[s][i], subroot, root, proof, met, met == root))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    docs = docs.withColumn("tree", F.lit(1)).withColumn("idx", F.lit("x")).withColumn("root", F.lit(None))
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    met = merkle_manifest.leaf_digest(*[bare if c == "text" else F.col(c) for c in LEAF])
    tampered = (remainder(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n"))
    return sorted(map(tuple, manifest(docs, F.when(tampered, met), **options).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_against_plain_hashing(spark, height):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}\nline") for i in range(61)]
    rows += [(1000 + i, None, None, None, None if i % 2 else "") for i in range(4)]
    rows += [(7000, "alone", "é", 3, "日本\n")]
    rows += [(None, "s1", "en", 1, "no id\n"), (5, "s2", "en", 1, "twice"), (5, "s2", "en", 1, "twice")]
    got = run(spark, rows, height=height)
    assert got == plainly(rows)
    assert {g[-1] for g in got} == {True, False}


def test_many_sources_and_levels(spark):
    rows = [(i, f"src{i % 40:02d}", "en", 1, "x" * (i % 5)) for i in range(400)]
    assert run(spark, rows, height=1) == plainly(rows)


def test_single_row_and_empty_table(spark):
    rows = [(1, "s", "en", 2, "a\n" * 200_000)]
    assert run(spark, rows) == plainly(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("height", range(7))
def test_storage_order(height):
    """Every node has its own place, a subtree split off at half height is one stretch."""
    places = [address(height, level, np.arange(3**level)) for level in range(height + 1)]
    assert sorted(np.concatenate(places)) == list(range(node_count(height)))
    if height:
        upper = (height + 1) // 2
        for first in range(3**upper):
            below = [places[level][first * 3 ** (level - upper) : (first + 1) * 3 ** (level - upper)] for level in range(upper, height + 1)]
            stretch = np.sort(np.concatenate(below))
            assert (np.diff(stretch) == 1).all() and len(stretch) == node_count(height - upper)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_paths_of_a_block(n):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    layout = lay_out(leaves, 3)
    root = layout[:32].hex()
    for leaf, path in zip(leaves, paths(layout, n, 3), strict=True):
        assert merkle_manifest.fold(leaf.hex(), path) == root
    assert merkle_manifest.fold(sha256(b"other").hexdigest(), paths(layout, n, 3)[0]) != root
