"""Collocations against plain counting, over many small partitions so that runs cross borders."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import count_streams
from corpusloom.llm.count_streams import collocations


def plainly(rows, longest=5, least=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    gone = set()
    for (lang, p), v in candidates.items():
        for m in range(2, len(p)):
            gone |= {(lang, q) for i in range(len(p) - m + 1) if v >= f[lang, q := p[i : i + m]]}
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in found.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])
    )


def drawn(n, seed):
    import random

    draw = random.Random(seed)
    words = ["a", "b", "Ab", "é", "x-y", "\x01z", "of", "the", "日本"]
    gaps = [" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!?"]
    texts = []
    for k in range(n):
        size = draw.choice([0, 1, 3, 40, 200])
        body = "".join(draw.choice(words[: 2 + k % 8]) + draw.choice(gaps) for _ in range(size))
        texts.append((draw.choice(["en", "de", None, "und"]), body if draw.random() > 0.05 else None))
    return texts + [("en", "the red fox runs on. " * 30), ("en", "the red fox runs on. " * 30)]


@pytest.fixture
def many_partitions(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(count_streams, "RANGE_WINDOWS", 40)
    monkeypatch.setattr(count_streams, "BLOCK_WINDOWS", 16)
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("vocabulary_bytes", [1 << 20, 0])
def test_against_plain_counting(spark, many_partitions, vocabulary_bytes):
    rows = drawn(60, 1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations(docs, least=4, top=50, vocabulary_bytes=vocabulary_bytes).collect()
    assert sorted(map(tuple, got)) == plainly(rows, least=4, top=50)


def test_long_text_is_cut_at_stops_only(spark, monkeypatch):
    """A text far beyond one run counts as if it were read at once."""
    rows = [("en", "one two three four five six. seven eight nine " * 50), ("en", "one two " * 200)]
    want = plainly(rows, least=10)
    body = __import__("numpy").frombuffer(rows[0][1].encode(), "uint8")
    cut = count_streams._cut_long(body, __import__("numpy").array([0, len(body)]), 100)
    assert len(cut) > 15 and all(body[c - 1] in b".,;:!?\n" for c in cut[1:-1])
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations(docs, least=10).collect())) == want


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).collect() == []
    bare = spark.createDataFrame([("en", None), (None, ""), ("en", " .,\n ")], "lang string, text string")
    assert collocations(bare, least=1).collect() == []


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame([("en", "a b. " * 9)], "lang string, text string")
    named = docs.select("*", *[F.lit(7).alias(c) for c in ("key", "n", "id", "word", "rank", "task")])
    assert [tuple(r) for r in collocations(named, least=5).collect()] == [("en", 1, "a b", 9, 9, 9, 18, 2000)]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    made = spark.range(1).select(
        count_streams.association_score(F.lit(big), F.lit(9 * big), F.lit(big + 7), F.lit(big + 1)).alias("s")
    )
    assert made.first().s == 1000 * big * 9 * big // ((big + 7) * (big + 1))
