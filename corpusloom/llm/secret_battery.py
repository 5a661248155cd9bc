"""Secret scan: pattern spans, plus strings that a battery of randomness tests cannot reject.

Every long mixed-class string gets an inferred encoding. Under the hypothesis that its symbols
are drawn evenly and independently from that alphabet, three tests (chi-squared uniformity,
runs about the middle of the alphabet, lag-1 serial correlation) give p-values, combined by
Fisher's rule. Benjamini-Hochberg then controls false discoveries of "not random" inside each
octave of length, because short strings have little power and would drown in one pool. What is
not discovered stays a secret.

All of it is column expressions; the only table beyond one row per document is the histogram
of p-values, whose size is fixed by ``P_STEPS`` and the number of octaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import let, matches_at
from corpusloom.runtime import materialize

# The patterns of the base kinds, and the characters a match must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
Q = 0.05
P_STEPS = 16  # histogram cells for each factor e
P_LEAST = 1e-12

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: pattern the whole string fits, alphabet. The first that fits is inferred.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _LOWER + _DIGITS),
    ("upper36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _UPPER + _DIGITS),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("url64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the rational form of Abramowitz and Stegun 26.2.17."""
    # Its coefficients.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _p_value(values: Column, size: Column) -> Column:
    """Combined p-value of one string: ``values`` are its symbols as DOUBLE 0..size-1."""

    def battery(s: Column) -> Column:
        v, mean = s["v"], s["mean"]
        n = F.size(v).cast("double")
        counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c.cast("double"))
        chi, df = squares * size / n - n, size - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(
            2 / (9 * df)
        )
        head, rest = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
        high = _sum(F.transform(v, lambda x: (x >= size / 2).cast("double")))
        turns = _sum(
            F.zip_with(head, rest, lambda a, b: ((a >= size / 2) != (b >= size / 2)).cast("double"))
        )
        both = 2 * high * (n - high)
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(
            (both > n), F.abs(1 + turns - (both / n + 1)) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
        ).otherwise(F.lit(8.0))
        about = _sum(F.transform(v, lambda x: (x - mean) * (x - mean)))
        lag = _sum(F.zip_with(head, rest, lambda a, b: (a - mean) * (b - mean)))
        z_lag = F.when(about > 0, F.abs(lag / about) * F.sqrt(n)).otherwise(F.lit(8.0))
        logs = [
            -F.ln(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))
            for p in (_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_lag))
        ]
        return let(logs[0] + logs[1] + logs[2], lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(
        values, lambda v: let(F.struct(v.alias("v"), (_sum(v) / F.size(v)).alias("mean")), battery)
    )


def _alphabet(token: Column) -> Column:
    chosen = None
    for _, fits, symbols in ENCODINGS:
        chosen = (F.when if chosen is None else chosen.when)(token.rlike(fits), F.lit(symbols))
    return chosen


def _random_strings(text: Column) -> Column:
    """Long strings of a known encoding: array of (start, end, octave, cell of the p-value)."""
    found = F.transform(
        F.filter(matches_at(text, CANDIDATE), lambda m: m["found"].rlike("[0-9]")),
        lambda m: let(
            F.regexp_replace(m["found"], "=+$", ""),
            lambda s: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                s.alias("token"), _alphabet(s).alias("alphabet"),
            ),
        ),
    )
    known = F.filter(found, lambda c: c["alphabet"].isNotNull())

    def scored(c: Column) -> Column:
        values = F.transform(
            F.split(c["token"], ""),
            lambda ch: (F.instr(c["alphabet"], ch) - 1).cast("double"),
        )
        p = _p_value(values, F.length(c["alphabet"]).cast("double"))
        return F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.floor(F.log2(F.length(c["token"]).cast("double"))).cast("int").alias("octave"),
            F.floor(-F.ln(F.greatest(p, F.lit(P_LEAST))) * P_STEPS + 1e-9).cast("int").alias("cell"),
        )

    return F.transform(known, scored)


def rejection_cells(cells: DataFrame, q: float = Q) -> DataFrame:
    """Benjamini-Hochberg per octave over (octave, cell): the first cell that is rejected.

    A cell counts with its largest p-value, so the control is never weaker than asked. The
    histogram is bounded (octaves times ``P_STEPS`` times 28), whatever the number of rows.
    """
    counts = cells.groupBy("octave", "cell").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("octave").orderBy(F.desc("cell"))
    ranked = counts.select(
        "octave",
        "cell",
        F.sum("n").over(down).alias("rank"),
        F.sum("n").over(Window.partitionBy("octave")).alias("all"),
    )
    passes = F.exp(-F.col("cell") / P_STEPS) <= q * F.col("rank") / F.col("all")
    return ranked.where(passes).groupBy("octave").agg(F.min("cell").alias("first_rejected"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, rank, end, kind).

    Spans are in code points, end exclusive, sorted by start, then kind. A null text is empty
    and has no span; repeated rows are scanned each for itself; an empty table gives no rows.
    A random string that touches a pattern span is not listed again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    span = "struct<start:int,rank:int,end:int,kind:string>"

    def base(rank: int, pattern: str) -> Column:
        found = matches_at(body, pattern)
        if rank == 0:
            least = F.lit(ASSIGN_LEAST)
            found = F.filter(
                found,
                lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= least,
            )
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"),
                m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"),
            ),
        ).cast(f"array<{span}>")

    scanned = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            F.concat(base(0, ASSIGN), base(1, ACCESS), base(2, HEX)).alias("base"),
            _random_strings(body).alias("strings"),
        )
    )
    cells = scanned.where(F.size("strings") > 0).select(F.inline("strings")).select("octave", "cell")
    # one row an octave of length: at most 32
    limits = {r["octave"]: r["first_rejected"] for r in rejection_cells(cells, q).collect()}

    def first_rejected(c: Column) -> Column:
        chosen = F.lit(2**31 - 1)
        for octave, first in limits.items():
            chosen = F.when(c["octave"] == octave, first).otherwise(chosen)
        return chosen

    random = F.transform(
        F.filter(
            F.col("strings"),
            lambda c: (c["cell"] < first_rejected(c))
            & ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
        ),
        lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"),
            c["end"].alias("end"), F.lit("random").alias("kind"),
        ),
    ).cast(f"array<{span}>")
    return scanned.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
