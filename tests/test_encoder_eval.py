import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import embeddings as E
from corpusloom.operators import pairs


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture
def written(monkeypatch):
    tables, write = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda df: tables.append(write(df)) or tables[-1])
    return tables


def test_pairs_are_counted_as_they_are_scored(spark, written):
    """Only the different (cosine, label) are written and joined; the figures are those of all pairs."""
    rng = np.random.default_rng(3)
    kinds = [([float(v) for v in rng.integers(-3, 4, 4)], [float(v) for v in rng.integers(1, 4, 4)], x) for x in (0.1, 0.2, 0.4, None) for _ in range(5)]
    rows = [kinds[i] for i in rng.integers(0, len(kinds), 3000)]
    got = E.evaluate_encoder(spark.createDataFrame(rows, "vec_a array<double>, vec_b array<double>, label double")).first()
    assert all(t.count() <= len(kinds) for t in written)
    cos = np.round([np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) if any(a) else 0.0 for a, b, _ in rows], 6)
    label = np.array([np.nan if x is None else x for *_, x in rows])
    known = ~np.isnan(label)
    rank = ranks(cos)[known]  # pairs without a label take part in the ranks of the cosine
    assert got.n_pairs == known.sum()
    assert abs(got.pearson - np.corrcoef(cos[known], label[known])[0, 1]) < 1e-9
    assert abs(got.spearman - np.corrcoef(rank, ranks(label[known]))[0, 1]) < 1e-9


def test_nothing_to_correlate(spark):
    schema = "vec_a array<double>, vec_b array<double>, label double"
    assert tuple(E.evaluate_encoder(spark.createDataFrame([], schema)).first()) == (0, None, None)
    one = [([1.0, 2.0], [2.0, 3.0], 0.1)]
    assert tuple(E.evaluate_encoder(spark.createDataFrame(one, schema)).first()) == (1, None, None)


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 2.0], [2.0, 3.0]), (None, [1.0]), ([1.0, None], [1.0, 2.0]), ([1.0, 0.0, 2.0], [1.0, 2.0]),
            ([0.0, 0.0], [1.0, 2.0, 3.0]), ([], []), ([float("nan")], [1.0]), ([3.0], [-2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").repartition(1)
    got = sorted((str(r.a), r.c) for r in df.select("a", V.cosine(F.col("a"), F.col("b")).alias("c")).collect())
    want = {"[1.0, 2.0]": 8 / np.sqrt(65), "[1.0, 0.0, 2.0]": None, "[nan]": np.nan, "[3.0]": -1.0}
    for a, c in got:
        w = want.get(a, 0.0)
        assert c is None if w is None else np.isclose(c, w, equal_nan=True)


def test_letters_of_long_and_missing_texts(spark, monkeypatch):
    import pyarrow as pa

    texts = ["", "abz" * 50, None, "é-ß z", "y" * 31, "", None]
    for limit in (7, 1 << 20):
        monkeypatch.setattr(E, "_LETTER_BYTES", limit)
        got = E._letter_counts(pa.array(["skipped", *texts])[1:]).to_pylist()
        assert got == [[None] * 26 if t is None else [float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    row = spark.createDataFrame([("Kİ Zz",)], "t string").select(E.letter_profile(F.col("t"))).first()[0]
    assert (row[8], row[10], row[25]) == (1.0, 1.0, 2.0)


def test_no_pair_carries_its_document_to_python(spark):
    """Texts are split once, and what a column function reads is the pair, not all sentences."""
    df = spark.createDataFrame([(i, ". ".join(f"Sentence number {k:03d}" for k in range(8))) for i in range(4)], "doc_id long, text string")
    both = pairs.training_pairs(df).select(E.letter_profile(F.col("text_a")), E.letter_profile(F.col("text_b")))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "text#" not in plan
    assert plan.count("ArrowEvalPython") == 2 and plan.count("Generate explode") == 2
