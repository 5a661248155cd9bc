"""Quality classifier: a small convolutional network over the bytes of the whole text.

Each text is cut into chunks of ``CHUNK`` bytes that overlap by one filter width. Bytes are
embedded, learned filters run over every chunk, each filter keeps its maximum over all chunks
of the text, and a logistic unit makes one probability of the maxima. The network is trained
in numpy on a bounded sample of labelled rows and scores texts inside Arrow tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packed_text import buffers

EMBED, STEP, FILTERS = 8, 4, 32  # a filter spans two steps of bytes
CHUNK = 1 << 16

#: Bounds of the training sample: rows, and bytes of the longest row used for fitting.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 16


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED, the last for padding
    near: np.ndarray  # STEP*EMBED x FILTERS, first half of each filter
    far: np.ndarray  # second half
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def halves(self) -> np.ndarray:
        return np.hstack([self.near, self.far])

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.near, self.far, self.bias, self.out, self.out_bias]


def new_network(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    width = STEP * EMBED

    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    embed = draw(257, EMBED, scale=0.5)
    return Network(
        embed, draw(width, FILTERS, scale=0.2), draw(width, FILTERS, scale=0.2),
        np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.1), np.zeros(1, np.float32),
    )


def _padded(body: np.ndarray) -> np.ndarray:
    """Byte codes, filled up to whole steps and at least one filter."""
    steps = max(2, -(-len(body) // STEP))
    codes = np.full(steps * STEP, 256, np.int16)
    codes[: len(body)] = body
    return codes


def _chunks(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Chunks overlapping by one step: every filter position lies in exactly one chunk."""
    for start in range(0, len(codes) - STEP, CHUNK):
        yield start, codes[start : start + CHUNK + STEP]


def _responses(net: Network, codes: np.ndarray) -> np.ndarray:
    """Filter outputs at every step of one chunk."""
    steps = np.take(net.embed, codes, 0).reshape(-1, STEP * EMBED)
    both = steps @ net.halves()
    return both[:-1, :FILTERS] + both[1:, FILTERS:]


def maxima(net: Network, body: np.ndarray) -> np.ndarray:
    """Maximum of every filter over the whole text."""
    tops = [_responses(net, chunk).max(0) for _, chunk in _chunks(_padded(body))]
    return tops[0] if len(tops) == 1 else np.max(tops, 0)


def pooled(net: Network, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``maxima``, and the step where each stands."""
    best = np.full(FILTERS, -np.inf, np.float32)
    where = np.zeros(FILTERS, np.int64)
    codes = _padded(body)
    for start, chunk in _chunks(codes):
        r = _responses(net, chunk)
        at = r.argmax(0)
        top = r[at, np.arange(FILTERS)]
        better = top > best
        best[better], where[better] = top[better], at[better] + start // STEP
    return best, where


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the logistic loss. Only the winning position of a filter carries its gradient."""
    net = new_network(seed)
    if not texts:
        return net
    rng = np.random.default_rng(seed + 1)
    y = np.asarray(labels, np.float32)
    share = np.clip(y.mean(), 0.01, 0.99)
    net.out_bias[0] = np.log(share / (1 - share))
    bodies = [np.frombuffer(t, np.uint8) for t in texts]
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    step = 0
    total = epochs * -(-len(bodies) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bodies))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            grads = [np.zeros_like(p) for p in net.parts()]
            for i in rows:
                _backward(net, bodies[i], y[i], grads, 1 / len(rows))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _backward(net: Network, body: np.ndarray, label: float, grads: list[np.ndarray], weight: float) -> None:
    best, where = pooled(net, body)
    raw = best + net.bias
    hidden = np.maximum(raw, 0)
    error = (_sigmoid(hidden @ net.out + net.out_bias[0]) - label) * weight
    embed, near, far, bias, out, out_bias = grads
    out += error * hidden
    out_bias += error
    back = error * net.out * (raw > 0)
    bias += back
    codes = _padded(body)
    span = (where[:, None] * STEP + np.arange(2 * STEP)).ravel()
    symbols = codes[span].reshape(FILTERS, 2, STEP)
    inputs = net.embed[symbols].reshape(FILTERS, 2, STEP * EMBED)
    near += (inputs[:, 0] * back[:, None]).T
    far += (inputs[:, 1] * back[:, None]).T
    into = np.stack([net.near.T, net.far.T], 1) * back[:, None, None]
    np.add.at(embed, symbols.ravel(), into.reshape(-1, EMBED))


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for every text; an empty text is all padding."""
    body, offsets = buffers(texts)
    pools = [maxima(net, body[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if not pools:
        return np.empty(0)
    hidden = np.maximum(np.stack(pools) + net.bias, 0).astype(np.float64)
    return _sigmoid(hidden @ net.out + net.out_bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` labelled rows outside ``held_out``, chosen by a hash of the id.

    Rows of more than ``longest`` bytes are not used for fitting (they are scored all the
    same). Null labels and ids are left out; an id that is labelled twice counts once.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    # a few spare ids, for those that have no text or too long a text
    chosen = (
        known.groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows + rows // 4)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    # the chosen ids are bounded by the parameter
    return (
        texts.where(F.octet_length("_text") <= longest)
        .join(F.broadcast(chosen), "_id")
        .select(F.col("_text").alias("text"), F.col("_y").alias("label"), F.col("_id").alias("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    )


def train(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int = SAMPLE_ROWS) -> Network:
    """Fit on the bounded sample (at most ``rows`` times ``SAMPLE_BYTES`` bytes, documented above)."""
    sample = training_rows(docs, labels, label, held_out, rows).collect()
    return fit([r["text"].encode() for r in sample], [r["label"] for r in sample])


def score_texts(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row, over the whole text.

    A null text is an empty one; an empty table gives no rows; repeated rows are scored each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a few ten kB
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i) for i in range(len(keep))]
            values = pa.array(scores(shared.value, b.column(len(keep))), pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, values], [*keep, "score"])

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(
        run, f"{schema}, score double"
    )


def keep_good(docs: DataFrame, net: Network, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(shared.value, b.column(at)) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
