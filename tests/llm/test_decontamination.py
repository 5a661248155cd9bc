import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import fm_index
from corpusloom.llm.fm_index import decontaminate, patterns, scan, suffix_array
from test_licenses import words_of


def brute(text, items, window=13):
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        w = words_of(body)
        wins = [w[k : k + window] for k in range(max(len(w) - window, 0) + 1)] if w else []
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
    return len(words), hit, sorted(str(i) for i in found if i is not None)


def fixture(rng, n_docs=60):
    vocab = ["a", "B", "cc", "Straße", "x1", "É", "日本", "the", "of"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)]
    items += [(None, "x1 x1 x1"), (98, None), (99, items[-1][1]), (99, "zz zz")]
    docs = [None, "", "..", "the " * 300]
    for _ in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(" ".join(rng.choice(vocab + ["other", "noise"]) for _ in range(rng.randint(0, 20))))
            body = rng.choice(items)[1] or ""
            w = body.split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts.append(rng.choice([body, " ".join(w[a : a + rng.randint(10, 16)]).upper()]))
        docs.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return docs + docs[5:9] * 3, items


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 400):
        for _ in range(6):
            s = rng.integers(0, 3, n)
            s[-1] = 0
            ends = np.cumsum(s == 0) - 1
            value = [(0, int(ends[i])) if s[i] == 0 else (1, int(s[i])) for i in range(n)]
            want = sorted(range(n), key=lambda i: value[i:])
            assert suffix_array(s).tolist() == want


def test_shards(monkeypatch):
    """Small shards: long texts are cut, with overlap."""
    docs, items = fixture(random.Random(1))
    known = patterns(items)
    for shard in (40, 1 << 20):
        monkeypatch.setattr(fm_index, "SHARD_WORDS", shard)
        n = 0
        for first, n_words, spans, found in scan(pa.array(docs), known):
            for k in range(len(n_words)):
                words, hit, names = brute(docs[first + k], items)
                assert n_words[k] == words
                assert {i for a, b in spans[k] for i in range(a, b)} == hit
                assert sorted({str(items[i][0]) for i in found[k] if items[i][0] is not None}) == names
                n += 1
        assert n == len(docs)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 100])
def test_operator(spark, table, pass_bytes):
    docs, items = fixture(random.Random(2), 25)
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as spans")
    got = decontaminate(table(docs, items=1, n_words="x"), bench, pass_bytes=pass_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        words, hit, names = brute(docs[r.doc_id], items)
        assert (r.n_words, r.items) == (words, names)
        assert {i for s in r.spans for i in range(s["start"], s["end"])} == hit


def test_empty(spark, table):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate(none, bench).count() == 0
    rows = decontaminate(table([(None, "a b"), (None, "a b")]), bench.limit(0)).collect()
    assert [(r.n_words, r.spans, r.items) for r in rows] == [(2, [], [])] * 2
