"""Sets of hashed word shingles, computed in numpy for a run of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusloom.llm.packed_text import LOWER, SPACED, mix, pieces, word_hashes, words

#: Bytes of text worked on at once; a longer text is a run of its own.
RUN_BYTES = 1 << 20

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def shingle_hashes(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words and the texts they stand in, in text order.

    A text of fewer words is one shingle; a text without words has none. 64 bits are taken as
    the shingle itself: in a corpus of 10**9 different shingles about one pair in forty such
    corpora would be confused.
    """
    low = LOWER[body]
    s, e, of = words(low, offsets, SPACED)
    h = word_hashes(low, s, e)
    n = len(h) - size + 1
    if n > 0:
        whole = of[:n] == of[size - 1 :]
        total = np.zeros(n, _U)
        for k in range(size):
            total = total * _STEP + h[k : k + n]
        full, text = mix(total[whole]), of[:n][whole]
    else:
        full, text = np.empty(0, _U), np.empty(0, np.int64)
    count = np.bincount(of, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(of, short)
        odd = np.empty(len(short), _U)
        for k, (t, a) in enumerate(zip(short, first, strict=True)):
            total = _U(count[t])
            for w in h[a : a + count[t]]:
                total = total * _STEP + w
            odd[k] = total
        at = np.searchsorted(text, short)
        full, text = np.insert(full, at, mix(odd + _U(size))), np.insert(text, at, short)
    return full, text


def ordered_shingles(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, shingle hashes in text order, the row of each in the run."""
    for first, _, body, offsets in pieces(texts, RUN_BYTES):
        with np.errstate(over="ignore"):
            yield first, *shingle_hashes(body, offsets, size)


def distinct_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, all sets one after the other (each sorted), their borders."""
    for first, stop, body, offsets in pieces(texts, RUN_BYTES):
        with np.errstate(over="ignore"):
            h, of = shingle_hashes(body, offsets, size)
        cuts = np.searchsorted(of, np.arange(stop - first + 1))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            h[a:z].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        yield first, h, np.searchsorted(of, np.arange(stop - first + 1))
