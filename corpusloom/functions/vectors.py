"""Vector arithmetic on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two ``array<double>`` columns."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    v = doubles(vector)
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero, null or has a null entry, null when only the sizes differ."""
    return F.arrow_udf(_cosines, "double")(doubles(a), doubles(b))


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    sides = [_Rows(a), _Rows(b)]
    lengths = np.sqrt(sides[0].products(sides[0])) * np.sqrt(sides[1].products(sides[1]))
    known = sides[0].whole & sides[1].whole & (lengths != 0)  # NaN stays
    same = sides[0].sizes == sides[1].sizes
    with np.errstate(all="ignore"):
        found = np.where(known & same, sides[0].products(sides[1]) / lengths, 0.0)
    return pa.array(found, mask=known & ~same)


class _Rows:
    """The vectors of a batch, by size."""

    def __init__(self, lists: pa.Array):
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        self.values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.whole = lists.is_valid().to_numpy(zero_copy_only=False)
        if flat.null_count:
            gaps = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
            self.whole &= gaps[self.starts] == gaps[self.starts + self.sizes]

    def products(self, other: _Rows) -> np.ndarray:
        """Inner products of rows of one size, added from the first entry to the last; 0 for other rows."""
        out = np.zeros(len(self.sizes))
        with np.errstate(all="ignore"):
            for size in np.unique(self.sizes):
                at = np.flatnonzero((self.sizes == size) & (other.sizes == size))
                x, y, total = self.starts[at], other.starts[at], np.zeros(len(at))
                for i in range(size):
                    total += self.values[x + i] * other.values[y + i]
                out[at] = total
        return out


def to_text(vector: Column) -> Column:
    """Vector as a JSON list."""
    return F.to_json(vector)


def parse(text: Column) -> Column:
    """Vector from a JSON list, else from a whitespace-separated one, else null.

    A cell that fits neither form yields null for its own row only.
    """
    listed = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    inner = F.trim(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""))
    spaced = F.transform(F.split(inner, r"\s+"), lambda x: x.try_cast("double"))
    good = lambda v: F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), v)
    return F.coalesce(good(listed), good(spaced))
