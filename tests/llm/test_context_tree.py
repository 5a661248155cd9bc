import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import context_tree
from corpusloom.llm.context_tree import DEPTH, EDGE, count_corpus, learn, log_kt, score_corpus, text_scores
from corpusloom.llm.queries import remainder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """Plain recursive context-tree weighting, one tree for each decision of a byte."""

    def __init__(self, texts, kept):
        self.kept = kept
        self.counts = Counter()
        for t in texts:
            s = [EDGE] * DEPTH + list(t) + [EDGE]
            for i in range(DEPTH, len(s)):
                for d in range(DEPTH + 1):
                    self.counts[(tuple(s[i - d : i]), s[i])] += 1
        self.children = {}
        for c in kept:
            if c:
                self.children.setdefault(c[1:], []).append(c)
        self.memo = {}

    def zeros_ones(self, context, u):
        bits = u.bit_length() - 1
        out = [0, 0]
        for s in range(256):
            if ((s | 256) >> (8 - bits)) == u:
                out[(s >> (7 - bits)) & 1] += self.counts[(context, s)]
        return out

    def rest(self, context, u):
        a, b = self.zeros_ones(context, u)
        for c in self.children.get(context, []):
            x, y = self.zeros_ones(c, u)
            a, b = a - x, b - y
        return a, b

    def weighted(self, context, u):
        if (context, u) not in self.memo:
            own = kt(*self.zeros_ones(context, u))
            if context in self.children:
                below = kt(*self.rest(context, u)) + sum(self.weighted(c, u) for c in self.children[context])
                own = np.logaddexp(own, below) + math.log(0.5)
            self.memo[(context, u)] = own
        return self.memo[(context, u)]

    def one(self, context, history, u):
        """Probability of 1 at decision ``u``, seen from ``context`` down."""
        a, b = self.zeros_ones(context, u)
        own = (b + 0.5) / (a + b + 1)
        if context not in self.children:
            return own
        w = math.exp(math.log(0.5) + kt(a, b) - self.weighted(context, u))
        longer = tuple(history[len(history) - len(context) - 1 :]) if len(context) < DEPTH else None
        if longer in self.kept:
            deeper = self.one(longer, history, u)
        else:
            x, y = self.rest(context, u)
            deeper = (y + 0.5) / (x + y + 1)
        return w * own + (1 - w) * deeper

    def score(self, t):
        s = [EDGE] * DEPTH + list(t) + [EDGE]
        total = 0.0
        for i in range(DEPTH, len(s)):
            u = 1
            for k in range(7, -1, -1):
                p = self.one((), s[i - DEPTH : i], u)
                bit = (s[i] >> k) & 1
                total += math.log10(p if bit else 1 - p)
                u = 2 * u + bit
        return total


@pytest.mark.parametrize("contexts", [1, 9, 60, 100000])
def test_tree(spark, table, contexts):
    rng = random.Random(1)
    texts = ["abra cadabra", "", None, "Abracadabra é", "ab" * 30] + ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(5)]
    grams = count_corpus(table(texts)).where("kind = 1").select("code", "n")
    tree = learn(grams, contexts)
    sums = Counter()
    for t in texts:
        s = [EDGE] * DEPTH + list(low(t)) + [EDGE]
        for i in range(DEPTH, len(s)):
            for d in range(DEPTH + 1):
                sums[tuple(s[i - d : i])] += 1
    kept = sorted(sums, key=lambda c: (-sums[c], len(c), bytes(c)))[:contexts]
    brute = Brute([low(t) for t in texts], set(kept))
    for t in [*texts, "new text", "zzz", "日本"]:
        body = np.frombuffer(low(t), np.uint8)
        got = text_scores(tree, body, np.array([0, len(body)]))[0]
        assert math.isclose(got, brute.score(low(t)), rel_tol=1e-5, abs_tol=1e-4), t
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(1), 1, atol=1e-4)


def test_log_kt():
    a = np.array([0, 1, 2, 50, 1e6, 3e9])
    b = np.array([0, 0, 7, 1, 5, 2e9])
    assert np.allclose(log_kt(a, b), [kt(x, y) for x, y in zip(a, b)], rtol=1e-9, atol=1e-9)


def held_out(doc_id):
    return F.coalesce(remainder(doc_id, 7) == 2, F.lit(True))


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_base_score(spark, table, monkeypatch, frequent):
    monkeypatch.setattr(context_tree, "FREQUENT", frequent)
    rng = random.Random(6)
    vocab = ["The", "the", "é", "É", "x,", "日本", "w" * 300] + [f"v{i}" for i in range(200)]
    texts = [None, "", "  \n"] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [*enumerate(texts), (None, "the null id"), (5, texts[5])]
    got = score_corpus(table(rows, row="x", words=1, score=2.0).repartition(3), held_out).collect()
    assert len(got) == len(rows)
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not out(d) for w in [*WORD.findall(low(t)), "end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*WORD.findall(low(t)), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((str(d), out(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_held_out_rows_teach_nothing(spark, table):
    ids = [i for i in range(400)]
    texts = [(i, f"word{i % 7} and more") for i in ids]
    other = [(i, t if zlib.crc32(str(i).encode()) % 7 != 2 else "entirely different") for i, t in texts]
    a = {r.doc_id: r.score for r in score_corpus(table(texts), held_out).collect()}
    b = {r.doc_id: r.score for r in score_corpus(table(other), held_out).collect()}
    for i in ids:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            assert math.isclose(a[i], b[i], abs_tol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert score_corpus(none, held_out).count() == 0


def test_nothing_to_learn_from(spark, table):
    row = score_corpus(table([(None, "a b")]), held_out).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert math.isclose(row.base_score, 0.0) and math.isclose(row.score, 4 * 8 * math.log10(0.5), rel_tol=1e-6)
