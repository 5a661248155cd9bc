import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm.length_buckets import on_grid, optimal_bounds, pack


def padding(lengths, counts, totals, bounds):
    waste, low = 0, -1
    for b in bounds:
        here = [(c, t) for x, c, t in zip(lengths, counts, totals) if low < x <= b]
        waste += sum(b * c - t for c, t in here)
        low = b
    return waste


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        m = rng.randint(1, 9)
        lengths = sorted(rng.sample(range(40), m))
        counts = [rng.randint(1, 9) for _ in lengths]
        totals = [x * c - rng.randint(0, min(2, x)) for x, c in zip(lengths, counts)]
        k = rng.randint(1, 4)
        got = optimal_bounds(*(np.array(x) for x in (lengths, counts, totals)), k)
        assert got[-1] == lengths[-1] and len(got) <= k
        best = min(
            padding(lengths, counts, totals, [*c, lengths[-1]])
            for n in range(min(k, m)) for c in itertools.combinations(lengths[:-1], n)
        )
        assert padding(lengths, counts, totals, got) == best


def test_many_bins():
    m = 1500
    lengths = np.arange(m) * 3
    counts = np.random.default_rng(0).integers(1, 50, m)
    fine = optimal_bounds(lengths, counts, lengths * counts, 12)
    even = [int(lengths[(i + 1) * m // 12 - 1]) for i in range(12)]
    assert padding(lengths, counts, lengths * counts, fine) <= padding(lengths, counts, lengths * counts, even)


def test_grid(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("x"), on_grid(F.col("id")).alias("g")).collect()
    for r in rows:
        assert r.g >= r.x and r.g - r.x < max(1, r.x / 256)
        assert r.x > 511 or r.g == r.x


def test_pack(spark, table):
    rng = random.Random(2)
    texts = [None, "", " ", "w " * 3000, "w " * 90] + ["w " * rng.randint(0, 200) for _ in range(500)] + ["same text"] * 200
    docs = table([*texts, (None, "a b"), (3, "again")], bucket="x", n_tokens=1, _row=2).repartition(4)
    rows = pack(docs, buckets=5, budget=1000).collect()
    assert len(rows) == len(texts) + 2
    batches = {}
    for r in rows:
        assert r.n_tokens + r.padding == r.bucket_length and r.padding >= 0
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1
        assert len(b) == 1 or sum(r.bucket_length for r in b) <= 1000
    for bucket in {r.bucket for r in rows}:
        sizes = [len(b) for b in batches.values() if b[0].bucket == bucket]
        assert sum(s < max(sizes) for s in sizes) <= 1  # only the last one is not full


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
