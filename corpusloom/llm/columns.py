"""Column idioms shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def totals_before(lengths: Column) -> Column:
    """Exclusive running totals of an INT array, in blocks so that long arrays stay cheap."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def with_blocks(s: Column) -> Column:
        lens, sums = s["lens"], s["sums"]
        starts = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return let(
            starts,
            lambda before: F.transform(
                lens,
                lambda _, i: F.get(before, (i / _BLOCK).cast("int"))
                + total(F.slice(lens, i - i % _BLOCK + 1, i % _BLOCK)),
            ),
        )

    def with_lengths(lens: Column) -> Column:
        blocks = F.when(
            F.size(lens) > 0,
            F.sequence(F.lit(0), ((F.size(lens) - 1) / _BLOCK).cast("int")),
        ).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: total(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(F.struct(lens.alias("lens"), sums.alias("sums")), with_blocks)

    return let(lengths, with_lengths)


def matches_at(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, found), in code points.

    Splitting and extracting by one pattern interleave, so lengths alone give positions.
    """
    pair = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )

    def placed(p: Column) -> Column:
        gaps, found = p["gaps"], p["found"]
        steps = F.transform(
            found, lambda m, i: F.length(F.get(gaps, i)) + F.when(
                i > 0, F.length(F.get(found, i - 1))
            ).otherwise(0)
        )
        return let(
            F.struct(
                found.alias("found"), steps.alias("steps"), totals_before(steps).alias("before")
            ),
            lambda s: F.transform(
                s["found"],
                lambda m, i: let(
                    F.get(s["before"], i) + F.get(s["steps"], i),
                    lambda at: F.struct(
                        at.alias("start"), (at + F.length(m)).alias("end"), m.alias("found")
                    ),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), let(pair, placed)).otherwise(none)
