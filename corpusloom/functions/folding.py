"""Compatibility folding of non-ASCII text to the ASCII letters it decomposes to."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def fold_rules() -> tuple[str, str, dict[str, str]]:
    """Derive the folding from Unicode NFKD.

    Returns ``(from_chars, to_chars, expansions)``: code points whose decomposition keeps
    exactly one letter or space, and those that keep several. All other code points keep
    nothing and are dropped by the letter filter that follows. Punctuation is left out: it
    is removed before decomposition.
    """
    singles: dict[str, str] = {}
    expansions: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] in "PC":
            continue
        parts = unicodedata.normalize("NFKD", char)
        if parts == char:
            continue
        kept = "".join(
            p
            for p in parts
            if not unicodedata.combining(p) and (p.isspace() or (p.isascii() and p.isalpha()))
        )
        if len(kept) == 1:
            singles[char] = kept
        elif kept:
            expansions[char] = kept
    return "".join(singles), "".join(singles.values()), expansions


def _covering_class(chars, gap: int = 64) -> str:
    """A character class of few ranges that covers ``chars``.

    It may match a little more, which only costs those rows the slower branch; a class
    listing every character costs every row a long chain of tests.
    """
    codes = sorted(ord(c) for c in chars)
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def fold(text: Column) -> Column:
    """Replace every non-ASCII character by the ASCII letters it decomposes to."""
    source, target, expansions = fold_rules()
    table = F.create_map(*[F.lit(x) for pair in expansions.items() for x in pair])
    spelled_out = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    expanded = F.when(text.rlike(_covering_class(expansions)), spelled_out).otherwise(text)
    return F.translate(expanded, source, target)


def lower_and_fold(text: Column) -> Column:
    """Lower-case and fold; rows of pure ASCII, told by their byte length, skip the folding."""
    lowered = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), lowered).otherwise(fold(lowered))
