"""Numpy over the bytes of many texts at once, for use inside Arrow tasks.

A batch of texts is one byte array and one offset array. UTF-8 keeps ASCII bytes apart from
the rest, so words cut at ASCII characters can be found, lower-cased and hashed on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_U = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for bytes outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for first, last in ranges:
        table[first : last + 1] = False
    return table


#: Words between white space, and words of letters, digits and everything beyond ASCII.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each.

    Tables for ordinary pieces are kept; those of a longer text go with it.
    """
    if n > PIECE_BYTES + 1:
        return _powers_of(_BASE, n), _powers_of(_INVERSE, n)
    if not _powers:
        _powers[:] = [_powers_of(base, PIECE_BYTES + 1) for base in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _powers_of(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps, out=steps)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (one longer text is a run of its own).

    Yields first row, row after the last, bytes, offsets.
    """
    body, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        cut = offsets[row : stop + 1]
        yield row, stop, body[cut[0] : cut[-1]], cut - cut[0]
        row = stop


def words(body: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; a word never crosses a text border."""
    inside = word_byte[body]
    n = len(body)
    first = inside.copy()
    last = inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, by differences of one running polynomial sum."""
    powers, inverse = _power_tables(len(body) + 1)
    sums = np.zeros(len(body) + 1, _U)
    np.cumsum(_BYTE_VALUES[body] * powers[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
