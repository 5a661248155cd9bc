"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each model sees the words of the text and the
log-odds of the categories before it. While fitting, those are out-of-fold predictions, so that
a later model learns how far an earlier one can be trusted. Models are logistic, on the words
that a chi-squared test ties to the category; words are hashed, and only their presence counts,
so the length of a text does not matter. Fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packed_text import LETTERS, LOWER, pieces, word_hashes, words

HASH_BITS = 20
FOLDS, RIDGE = 5, 0.1

#: Bounds of the training sample: rows, and bytes of the longest row used for fitting.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 1 << 16


@dataclass
class Model:
    features: np.ndarray  # hashed words, sorted
    weights: np.ndarray  # of the features
    chain: np.ndarray  # of the log-odds of earlier categories
    bias: float


def presence(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, rows, and the distinct pairs (row, hashed word)."""
    for first, stop, body, offsets in pieces(texts):
        low = LOWER[body]
        s, e, of = words(low, offsets, LETTERS)
        code = (word_hashes(low, s, e) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        pair = np.unique((of << HASH_BITS) | code)
        yield first, stop - first, pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _chosen(row: np.ndarray, code: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All words tied to the label: chi-squared beyond 1 in 1000."""
    n, positive = len(y), y.sum()
    df = np.bincount(code, minlength=1 << HASH_BITS)
    both = np.bincount(code, weights=y[row], minlength=1 << HASH_BITS)
    usual = np.flatnonzero((df >= 3) & (df < n))
    expected = df[usual] * positive / n
    spread = expected * (1 - positive / n) * (1 - df[usual] / n)
    chi = (both[usual] - expected) ** 2 / np.maximum(spread, 1e-9)
    return usual[chi > 10.83]


def _fit(row: np.ndarray, code: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's method, its steps by conjugate gradients on the sparse words."""
    features = _chosen(row, code, y)
    k, n = len(features), len(y)
    if k:
        col = np.minimum(np.searchsorted(features, code), k - 1)
        hit = features[col] == code
        row, col = row[hit], col[hit]
    else:
        row = col = np.empty(0, np.int64)
    dense = np.hstack([earlier, np.ones((n, 1))])

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=w[:k][col], minlength=n) + dense @ w[k:]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(col, weights=r[row], minlength=k), dense.T @ r])

    ridge = np.full(k + dense.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(len(ridge))
    w[-1] = _log_odds(np.array([y.mean()]))[0]
    for _ in range(25):
        p = _sigmoid(times(w))
        spread = p * (1 - p) + 1e-9
        scale = np.concatenate([np.bincount(col, weights=spread[row], minlength=k), (dense**2).T @ spread]) + ridge
        step = np.zeros(len(w))
        left = back(y - p) - ridge * w
        along = left / scale
        size = start = left @ along
        for _ in range(4 * len(w)):
            if size <= 1e-12 * start or size <= 1e-18:
                break
            bent = back(spread * times(along)) + ridge * along
            move = size / (along @ bent)
            step += move * along
            left -= move * bent
            new = left / scale
            size, old = left @ new, size
            along = new + size / old * along
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(features, w[:k], w[k:-1], float(w[-1]))


def _apply(model: Model, row: np.ndarray, code: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    out = np.full(n, model.bias)
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, code), len(model.features) - 1)
        hit = model.features[at] == code
        out += np.bincount(row[hit], weights=model.weights[at[hit]], minlength=n)
    return _sigmoid(out + earlier @ model.chain)


def fit_chain(texts: list[str], labels: np.ndarray, seed: int = 0) -> list[Model]:
    """One model for each column of ``labels`` (rows x categories, 0 or 1), in that order."""
    rows, codes = [], []
    for first, _, row, code in presence(pa.array(texts, pa.string())):
        rows.append(row + first)
        codes.append(code)
    n = len(texts)
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    code = np.concatenate(codes) if codes else np.empty(0, np.int64)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    models, earlier = [], np.empty((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out_of_fold = np.full(n, y.mean() if n else 0.0)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(inside) or not len(outside):
                continue
            model = _fit(*_subset(row, code, inside, n), earlier[inside], y[inside])
            r, c = _subset(row, code, outside, n)
            out_of_fold[outside] = _apply(model, r, c, len(outside), earlier[outside])
        models.append(_fit(row, code, earlier, y) if n else Model(np.empty(0, np.int64), np.empty(0), np.zeros(k), -30.0))
        earlier = np.hstack([earlier, _log_odds(out_of_fold)[:, None]])
    return models


def _subset(row: np.ndarray, code: np.ndarray, kept: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.full(n, -1)
    new[kept] = np.arange(len(kept))
    on = new[row] >= 0
    return new[row[on]], code[on]


def predict(models: list[Model], texts: pa.Array) -> np.ndarray:
    """Probabilities, rows x categories."""
    out = np.empty((len(texts), len(models)))
    for first, n, row, code in presence(texts):
        earlier = np.empty((n, 0))
        for k, model in enumerate(models):
            p = _apply(model, row, code, n, earlier)
            out[first : first + n, k] = p
            earlier = np.hstack([earlier, _log_odds(p)[:, None]])
    return out


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], held_out,
    rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES,
) -> list[Model]:
    """Fit on at most ``rows`` labelled rows (texts of at most ``longest`` bytes) not held out.

    ``categories`` are SQL conditions on ``labels``, first to last of the chain; a row with a
    null one is left out, as is a null id. Without any row every probability is near 0.
    """
    names = list(categories)
    flags = labels.select(
        F.col("doc_id").alias("_id"), *[F.expr(c).cast("int").alias(f"_{i}") for i, c in enumerate(categories.values())]
    ).dropna()
    # greatest label of an id that is labelled twice; bounded by the parameter
    chosen = (
        flags.where(~held_out(F.col("_id"))).groupBy("_id").agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(names))])
        .orderBy(F.xxhash64("_id"), "_id").limit(rows + rows // 4)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    sample = (
        texts.where(F.octet_length("_text") <= longest).join(F.broadcast(chosen), "_id")
        .orderBy(F.xxhash64("_id"), "_id", "_text").limit(rows).collect()
    )
    y = np.array([[r[f"_{i}"] for i in range(len(names))] for r in sample]).reshape(len(sample), len(names))
    return fit_chain([r["_text"] for r in sample], y)


def score_texts(docs: DataFrame, models: list[Model], names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one probability for each category, from the whole text.

    Null and empty texts have no words and get what the biases say; repeated rows are scored
    each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # 16 bytes for each word of a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = predict(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names]
            )

    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"`{n}` double" for n in names)
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(
        run, f"doc_id {kind}, {columns}"
    )
