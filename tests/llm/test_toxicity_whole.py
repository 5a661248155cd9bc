"""Every word that the test ties to a category counts, whatever its language."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import toxicity_chain


def test_recall_in_every_language():
    rng = np.random.default_rng(5)
    # the larger languages have more texts; each has toxic words of its own
    own = {f"l{i}": 8 if i < 8 else 1 for i in range(24)}
    texts, y, of, learn = [], [], [], []
    for name, n in own.items():
        for k in range(80 * n if n > 1 else 64):
            turn = k // 8
            words = [f"w{rng.integers(200)}" for _ in range(12)] + [f"{name}bad{turn % n}"] * (k % 8 == 0)
            texts.append(" ".join(words))
            y.append([int(k % 8 == 0)])
            of.append(name)
            learn.append(turn // n % 2 == 0)
    y, of, learn = np.array(y), np.array(of), np.array(learn)
    models = toxicity_chain.fit_chain([t for t, use in zip(texts, learn, strict=True) if use], y[learn])
    assert len(models[0].features) >= 8 * 8 + 16
    p = toxicity_chain.predict(models, pa.array(texts))[:, 0] >= 0.5
    for name in own:
        held = ~learn & (of == name)
        assert p[held & (y[:, 0] == 1)].mean() >= 0.9, name
        assert p[held & (y[:, 0] == 0)].mean() <= 0.1, name


def test_fit_is_the_ridge_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 40)) < 0.3
    y = (rng.random(300) < 1 / (1 + np.exp(-4 * (x[:, 0] + x[:, 1] - 1.0)))).astype(float)
    row, code = np.nonzero(x)
    earlier = rng.normal(size=(300, 1))
    model = toxicity_chain._fit(row, code, earlier, y)
    some = x[:, model.features].astype(float)
    p = 1 / (1 + np.exp(-(some @ model.weights + earlier @ model.chain + model.bias)))
    assert np.allclose(some.T @ (y - p), toxicity_chain.RIDGE * model.weights, atol=1e-4)
    assert abs((y - p).sum()) < 1e-3
