"""Global positions without a single-partition window.

Rows are range-partitioned and sorted on the order columns, written once, and numbered by
adding per-partition offsets (one row per partition). A hot value of the leading order
column does not matter as long as all the order columns together are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _laid_out(df: DataFrame, order: list) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slot = F.monotonically_increasing_id()
    return materialize(
        ranged.withColumn("_part", F.shiftright(slot, _SLOT_BITS).cast("int")).withColumn(
            "_slot", slot.bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
        )
    )


def _offsets(totals: DataFrame) -> DataFrame:
    """Exclusive running total over partitions; one input row per partition."""
    everything_before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", F.coalesce(F.sum("_total").over(everything_before), F.lit(0)).alias("_offset")
    )


def with_row_ids(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """Add a dense 0-based BIGINT row number in the order of ``order`` (a unique key)."""
    laid = _laid_out(df, order)
    offsets = _offsets(laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_total")))
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_slot"))
        .drop("_part", "_slot", "_offset")
    )


def with_running_total(df: DataFrame, order: list, weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come before in ``order``."""
    laid = _laid_out(df, order)
    offsets = _offsets(laid.groupBy("_part").agg(F.sum(weight).alias("_total")))
    before = Window.partitionBy("_part").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inner = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return (
        laid.withColumn("_inner", inner)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inner"))
        .drop("_part", "_slot", "_offset", "_inner")
    )


def index_in_group(df: DataFrame, group: str, order: list, name: str = "idx") -> DataFrame:
    """0-based position of every row inside its group; a hot group is not one task."""
    numbered = with_row_ids(df, [group, *order], "_rid")
    first = numbered.groupBy(group).agg(F.min("_rid").alias("_first"))
    return (
        numbered.join(first, group)
        .withColumn(name, F.col("_rid") - F.col("_first"))
        .drop("_rid", "_first")
    )


def factorize(df: DataFrame, label: str, position: str, name: str = "code") -> DataFrame:
    """Code every label by first appearance: 0 for the label seen first."""
    first = df.groupBy(label).agg(F.min(position).alias("_at"))
    codes = with_row_ids(first, ["_at", label], name).drop("_at")
    return df.join(codes, label)
