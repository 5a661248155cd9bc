import random

import numpy as np

from corpusloom.operators import graph


def test_layout_over_several_blocks(spark, monkeypatch):
    """Links stand in one row for two blocks, and the axes are eigenvectors of the whole graph."""
    monkeypatch.setattr(graph, "_BLOCK_NODES", 16)
    rng, n = random.Random(3), 50
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}
    rows = [(a, b, rng.uniform(0.2, 1.0)) for a, b in sorted(pairs)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    seen, pack = [], graph._packed_links

    def packed(*given):
        seen.append(pack(*given))
        return seen[0]

    monkeypatch.setattr(graph, "_packed_links", packed)
    found = {r.id: (r.x, r.y) for r in graph.spectral_layout(edges, 2, 1e-6).collect()}
    assert 4 < seen[0].count() <= 16
    w = np.zeros((n, n))
    for a, b, v in rows:
        w[a, b] = w[b, a] = v
    m = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    top = np.sort(np.linalg.eigvalsh(m))[::-1]
    v = np.array([found[i] for i in range(n)])
    for axis in (0, 1):
        assert np.linalg.norm(m @ v[:, axis] - top[axis + 1] * v[:, axis]) < 1e-4
