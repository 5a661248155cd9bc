import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import embeddings as E


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcdef") for _ in range(12)] + [f"once{i}"]) for i in range(40)]
    rows += [(40, ["alone"]), (41, []), (43, ["once1", "a"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def test_trainer_keeps_a_bounded_vocabulary(docs):
    fitted = E.fit_word2vec(docs, size=8, max_trained=6, numPartitions=1)
    assert {r.word for r in fitted.model.stages[0].getVectors().collect()} == set("abcdef")
    rare = {r.word: np.array(r.vector) for r in fitted.rare.collect()}
    assert set(rare) == {f"once{i}" for i in range(40)} | {"alone"}
    assert all(np.linalg.norm(v) > 0 for v in rare.values()) and len({tuple(v) for v in rare.values()}) == 41


def test_every_word_counts_in_the_mean(docs):
    fitted = E.fit_word2vec(docs, size=8, max_trained=6, numPartitions=1)
    known = {r.word: r.vector.toArray() for r in fitted.model.stages[0].getVectors().collect()}
    known |= {r.word: np.array(r.vector) for r in fitted.rare.collect()}
    rows = E.embed_with_model(docs, fitted).collect()
    assert len(rows) == 43
    for r in rows:
        want = np.mean([known[t] for t in r.tokens], axis=0) if r.tokens else np.zeros(8)
        assert np.allclose(r.embedding, want, atol=1e-6)


def test_all_words_are_trained_when_they_fit(docs):
    fitted = E.fit_word2vec(docs, size=8, numPartitions=1)
    assert not isinstance(fitted, E.WordVectors) and fitted.stages[0].getVectors().count() == 47


class Sent:
    """What a task sees of a broadcast."""

    def __init__(self, words, vectors):
        self.value = pa.array(words), np.vstack([vectors, np.zeros_like(vectors[:1])]).astype(np.float32)


@pytest.mark.parametrize("places", [3, 1 << 16])
def test_other_words_are_summed_before_they_travel(monkeypatch, places):
    """A batch gives a row a word, not a row an occurrence, with the mean of what stands around its places."""
    monkeypatch.setattr(E, "_PLACES", places)
    rng = random.Random(6)
    texts = [[rng.choice("abcdxyz") for _ in range(rng.randint(0, 30))] for _ in range(40)] + [None, ["x"], [None, "a"]]
    known = {w: np.arange(4) + 10.0 * i for i, w in enumerate("abcd")}
    sent = Sent(list(known), np.array(list(known.values())))
    batch = pa.RecordBatch.from_arrays([pa.array([["gone"], *texts])[1:]], ["t"])
    rows = [r for out in E._surroundings(sent, 2)([batch]) for r in out.to_pylist()]
    if places > 100:
        assert sorted(r["word"] or "" for r in rows) == ["", "x", "y", "z"]
    for word in ("x", "y", "z"):
        met = [t[max(i - 2, 0) : i + 3] for t in texts if t for i, w in enumerate(t) if w == word]
        want = sum(np.mean([known.get(w, np.zeros(4)) for w in around], axis=0) for around in met)
        mine = [r for r in rows if r["word"] == word]
        assert sum(r["n"] for r in mine) == len(met)
        assert np.allclose(sum(np.array([r[f"v{i}"] for i in range(4)]) for r in mine), want)
    found = E._trained_sums(sent)(batch.column(0)).to_pylist()
    for t, r in zip(texts, found, strict=True):
        assert np.allclose(r["total"], sum((known[w] for w in t or [] if w in known), np.zeros(4)))
        assert r["others"] == [w for w in t or [] if w not in known]


def test_other_words_start_by_hash_and_move_by_their_surroundings(docs):
    fitted = E.fit_word2vec(docs, size=8, max_trained=6, numPartitions=1)
    known = {r.word: r.vector.toArray() for r in fitted.model.stages[0].getVectors().collect()}
    rare = {r.word: np.array(r.vector) for r in fitted.rare.collect()}
    texts = [r.tokens for r in docs.collect()]
    starts = []
    for word, vector in rare.items():
        around = [t[max(i - 5, 0) : i + 6] for t in texts for i, w in enumerate(t) if w == word]
        moved = np.mean([np.mean([known.get(w, np.zeros(8)) for w in a], axis=0) for a in around], axis=0)
        starts.append(vector - moved)
    assert np.abs(starts).max() <= 0.5 / 8 + 1e-6 and len({tuple(np.round(s, 6)) for s in starts}) == len(rare)
