import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm.packed_text import LETTERS, LOWER, SPACED, buffers, pieces, word_hashes, words

PATTERNS = {"spaced": (SPACED, rb"[^\x20\x09-\x0D]+"), "letters": (LETTERS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def corpus(rng):
    parts = ["the", "The", "É", "日本", " ", "\n", "\t", "\x00", "a-b", "x1", "", "\x0b", "\x7f", " ", "w" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    return [None, "", *texts, "long word " * 500, None, ""]


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
@pytest.mark.parametrize("kind", list(PATTERNS))
def test_words(limit, kind):
    table, pattern = PATTERNS[kind]
    texts = corpus(random.Random(limit))
    seen, by_hash = 0, {}
    for first, stop, body, offsets in pieces(pa.array(texts), limit):
        assert first == seen
        seen = stop
        low = LOWER[body]
        s, e, of = words(low, offsets, table)
        with np.errstate(over="ignore"):
            h = word_hashes(low, s, e)
        for k in range(stop - first):
            want = re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in texts[first + k] or "").encode())
            got = [low[a:z].tobytes() for a, z in zip(s[of == k], e[of == k], strict=True)]
            assert got == want
        for a, z, x in zip(s, e, h.tolist(), strict=True):
            assert by_hash.setdefault(x, low[a:z].tobytes()) == low[a:z].tobytes()
    assert seen == len(texts)
    assert len(set(by_hash.values())) == len(by_hash)


def test_slices_and_wide_offsets():
    texts = corpus(random.Random(9))
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.chunked_array([texts[:50], texts[50:]], pa.string())):
        body, offsets = buffers(array.slice(7, 60))
        for k in range(60):
            assert body[offsets[k] : offsets[k + 1]].tobytes() == (texts[7 + k] or "").encode()
    assert len(buffers(pa.array([], pa.string()))[1]) == 1
