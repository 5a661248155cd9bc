import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import byte_cnn, toxicity_chain
from corpusloom.llm.queries import TOXICITY, held_out_quality, op6_toxicity, op10_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return {r.doc_id: r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_quality_on_held_out_rows(spark, labels):
    rows = {r.doc_id: r for r in op10_quality(spark, SF).collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    right = [rows[i].predicted == x.quality for i, x in labels.items()]
    assert np.mean(right) >= 0.9
    kept = [rows[i].predicted for i, x in labels.items() if x.quality == 1]
    assert np.mean(kept) >= 0.97


def test_toxicity_on_held_out_rows(spark, labels):
    rows = {r.doc_id: r for r in op6_toxicity(spark, SF).collect()}
    assert len(rows) == 1000
    clean = [rows[i].predicted for i, x in labels.items() if x.toxic == 0]
    toxic = [rows[i].predicted for i, x in labels.items() if x.toxic == 1]
    assert np.mean(clean) <= 0.02 and np.mean(toxic) >= 0.5


def test_pooling_covers_the_whole_text(monkeypatch):
    net = byte_cnn.new_network(3)
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 64, 65, 131, 1000):
        body = rng.integers(0, 256, n).astype(np.uint8)
        monkeypatch.setattr(byte_cnn, "CHUNK", 1 << 16)
        whole, where = byte_cnn.pooled(net, body)
        monkeypatch.setattr(byte_cnn, "CHUNK", 32)
        assert np.allclose(byte_cnn.maxima(net, body), whole, atol=1e-5)
        assert np.allclose(byte_cnn.pooled(net, body)[0], whole, atol=1e-5)
        codes = byte_cnn._padded(body)
        x = net.embed[codes]
        for f in range(0, byte_cnn.FILTERS, 7):
            kernel = np.concatenate([net.near[:, f], net.far[:, f]])
            direct = [x[i : i + 8].ravel() @ kernel for i in range(0, len(codes) - 7, 4)]
            assert np.isclose(max(direct), whole[f], atol=1e-4)
            assert np.isclose(direct[where[f]], whole[f], atol=1e-4)


def test_gradient():
    net = byte_cnn.new_network(1)
    for p in net.parts():
        p.flags.writeable = True
    body = np.frombuffer(b"some words to learn from", np.uint8)

    def loss():
        hidden = np.maximum(byte_cnn.maxima(net, body) + net.bias, 0).astype(float)
        p = 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias[0])))
        return -np.log(1 - p)

    grads = [np.zeros_like(p) for p in net.parts()]
    byte_cnn._backward(net, body, 0.0, grads, 1.0)
    for p, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-3
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert np.isclose((up - down) / (2 * eps), g[at], rtol=0.05, atol=1e-3)


def test_chain_uses_earlier_categories():
    """The second label follows the first one's words only through the chain."""
    rng = np.random.default_rng(2)
    texts, y = [], []
    for _ in range(600):
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        words = [f"w{rng.integers(300)}" for _ in range(20)] + ["vile"] * bad + ["rude"] * rude
        texts.append(" ".join(words))
        y.append([bad, bad and rude])
    models = toxicity_chain.fit_chain(texts, np.array(y).astype(int))
    p = toxicity_chain.predict(models, pa.array(texts))
    assert ((p >= 0.5) == np.array(y)).mean(0).min() >= 0.97
    assert models[1].chain[0] > 0


def test_odd_rows(spark, table):
    docs = table(
                 [(0, None), (1, ""), (2, "trash talk"), (None, "x"), (2, "trash talk"), (5, "long " * 200000)], score="x", label=1)
    labels = spark.createDataFrame([(2, 1, 1), (None, 0, 0), (1, None, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    net = byte_cnn.train(docs, labels, "quality", held_out_quality)
    got = byte_cnn.score_texts(docs, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    models = toxicity_chain.train(docs, labels, TOXICITY, held_out_quality)
    got = toxicity_chain.score_texts(docs, models, list(TOXICITY)).collect()
    assert len(got) == 6 and all(0 <= r.p_toxic <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert byte_cnn.score_texts(none, byte_cnn.train(none, labels.limit(0), "quality", held_out_quality)).count() == 0
    assert toxicity_chain.score_texts(none, toxicity_chain.train(none, labels.limit(0), TOXICITY, held_out_quality), list(TOXICITY)).count() == 0
