"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: the larger ones, or the smaller and oneself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where(F.col("v") < F.col("u"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        hung = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return hung.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Fingerprint of an edge set: it stops changing when every node hangs on its root."""
    r = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)
    ).first()
    return tuple(r)


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``edges`` (u, v).

    Rounds grow with the logarithm of the longest path. Each round is written, so a lost
    executor costs one round at most.
    """
    now = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    state = _state(now)
    while True:
        now = materialize(_star(_star(now, large=True), large=False))
        if (after := _state(now)) == state:
            break
        state = after
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
