"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; every decision has Krichevsky-Trofimov estimates in all
contexts of up to ``DEPTH`` preceding bytes, and the estimates of all depths are mixed by the
weights of the context-tree recursion. The counts are those of all training texts: runs of
``DEPTH + 1`` bytes are counted in the tasks and summed by one shuffle. Every context is kept.
A tree of at most ``CONTEXTS`` contexts goes to the tasks, which walk each byte down to its
deepest context. Beyond, the tree is a table of (context, decision): the weights are summed
level by level from the deepest contexts up, the mixtures follow from the root down, and
every counted byte run gets its probability. Blocks of texts then meet the runs they hold.
Both ways give the same scores.

The word counts of the plain base score come from the same pass. Counts of the ``FREQUENT``
most frequent words go to the tasks, all other words of a text are joined with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packed_text import LOWER, SPACED, pieces, word_hashes, words
from corpusloom.runtime import materialize

DEPTH = 4
#: Bounds of what every task holds: contexts (256 floats each), beyond which the tree is a table,
#: and frequent words (16 bytes each).
CONTEXTS, FREQUENT = 1 << 14, 1 << 17
#: Bytes of a block of texts (or one longer text) that meets its byte runs in one task.
BLOCK_BYTES = 32 << 20
#: A byte that UTF-8 never uses: before the first byte of a text, and after its last.
EDGE = 0xFF
_FLUSH_PIECES = 8
WORD, GRAM = 0, 1


def framed(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``DEPTH`` edge bytes before each and one after; positions of what is predicted."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH
    out = np.full(len(body) + n * (DEPTH + 1), EDGE, np.uint8)
    of = np.repeat(np.arange(n), sizes)
    out[np.arange(len(body)) + of * (DEPTH + 1) + DEPTH] = body
    predicted = np.ones(len(out), bool)
    lead = starts[:, None] - 1 - np.arange(DEPTH)
    predicted[lead.ravel()] = False
    return out, np.flatnonzero(predicted)


def gram_codes(framed_bytes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at each position and the ``DEPTH`` before it, oldest first, as one number."""
    code = np.zeros(len(at), np.int64)
    for back in range(DEPTH, -1, -1):
        code = (code << 8) | framed_bytes[at - back]
    return code


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in held])
    code, at = np.unique(codes, return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def count_corpus(docs: DataFrame, text: str = "text", learned: Column | None = None) -> DataFrame:
    """kind, code, n: counts of words (by hash) and byte runs over all rows of ``docs``.

    Rows that ``learned`` does not name count nothing, but their byte runs are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    code, n = _summed(parts)
                    held[kind] = []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), kind, np.int32)), pa.array(code), pa.array(n)],
                        ["kind", "code", "n"],
                    )

        for b in batches:
            teaches = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            for first, stop, body, offsets in pieces(b.column(0)):
                low = LOWER[body]
                s, e, of = words(low, offsets, SPACED)
                use = teaches[first:stop]
                runs = gram_codes(*framed(low, offsets))
                counts = np.repeat(use, np.diff(offsets) + 1)
                held[WORD].append(np.unique(word_hashes(low, s, e).view(np.int64)[use[of]], return_counts=True))
                held[GRAM].append(np.unique(runs[counts], return_counts=True))
                if not use.all():
                    listed = np.unique(runs[~counts])
                    held[GRAM].append((listed, np.zeros(len(listed), np.int64)))
                if len(held[GRAM]) >= _FLUSH_PIECES:
                    yield from flush()
        yield from flush()

    counted = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.lit(True) if learned is None else F.coalesce(learned, F.lit(False))).alias("learned"),
    ).mapInArrow(run, "kind int, code bigint, n bigint")
    return counted.groupBy("kind", "code").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    step: np.ndarray  # (2 * contexts) x 256: next state of the walk; beyond contexts: stopped
    log10: np.ndarray  # contexts x 256


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; exact to about 1e-11."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of any sequence with these counts under the KT estimator."""
    return (
        _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    )


_COLUMNS = 32  # decisions worked on at a time, to keep the driver small


def _mixtures(zeros: np.ndarray, ones: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Probability of 1 at some decisions (columns) with each context as the deepest one."""
    rest0, rest1, children = zeros.copy(), ones.copy(), np.zeros(len(parent), bool)
    np.subtract.at(rest0, parent[1:], zeros[1:])
    np.subtract.at(rest1, parent[1:], ones[1:])
    children[parent[1:]] = True
    own, below = log_kt(zeros, ones), log_kt(rest0, rest1)
    weighted = own.copy()
    for d in range(int(depth.max()), -1, -1):
        here = np.flatnonzero((depth == d) & children)
        weighted[here] = np.logaddexp(own[here], below[here]) + np.log(0.5)
        if d:
            level = np.flatnonzero(depth == d)
            np.add.at(below, parent[level], weighted[level])
    weight = np.exp(np.log(0.5) + own - weighted)  # of a context's own estimate
    weight[~children] = 1.0
    estimate = (ones + 0.5) / (zeros + ones + 1.0)
    rest = (rest1 + 0.5) / (rest0 + rest1 + 1.0)
    mixed = weight * estimate + (1 - weight) * rest
    up = np.arange(len(parent))
    for _ in range(int(depth.max())):
        at = np.flatnonzero(up != 0)
        up[at] = parent[up[at]]
        w = weight[up[at]]
        mixed[at] = w * estimate[up[at]] + (1 - w) * mixed[at]
    return mixed


def build_tree(contexts: list[tuple[int, int]], counts: np.ndarray) -> Tree:
    """From contexts (depth, code) with their counts (contexts x 256); the first is the empty one.

    Every context's suffixes must be among them.
    """
    k = len(contexts)
    index = {c: i for i, c in enumerate(contexts)}
    depth = np.array([d for d, _ in contexts])
    # the last byte before comes first on the walk: drop the oldest byte to get the parent
    parent = np.array([index[(d - 1, c & ((1 << 8 * (d - 1)) - 1))] if d else 0 for d, c in contexts])
    # heap order: decision u has the branches 2u and 2u + 1, symbol s is leaf 256 + s
    sums = np.zeros((k, 512))
    sums[:, 256:] = counts
    for u in range(255, 0, -1):
        sums[:, u] = sums[:, 2 * u] + sums[:, 2 * u + 1]
    logs = np.zeros((k, 512), np.float32)
    for lo in range(1, 256, _COLUMNS):
        u = np.arange(lo, min(lo + _COLUMNS, 256))
        one = _mixtures(sums[:, 2 * u], sums[:, 2 * u + 1], parent, depth)
        logs[:, 2 * u], logs[:, 2 * u + 1] = np.log10(1 - one), np.log10(one)
    for u in range(2, 512):
        logs[:, u] += logs[:, u // 2]
    step = np.empty((2 * k, 256), np.int32)
    step[:] = (np.arange(2 * k) % k + k)[:, None]
    for i, (d, c) in enumerate(contexts):
        if d:
            step[parent[i], c >> (8 * (d - 1))] = i
    return Tree(step, logs[:, 256:].copy())


def _nodes(grams: DataFrame) -> DataFrame:
    """depth, context, symbol, n: counted byte runs (code, n) under the contexts of all depths."""
    parts = F.array(
        *[
            F.struct(
                F.lit(d).alias("depth"),
                F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context"),
            )
            for d in range(DEPTH + 1)
        ]
    )
    return grams.select(F.inline(parts), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")


def learn(grams: DataFrame, contexts: int = CONTEXTS) -> Tree:
    """Tree of the most frequent contexts from counted byte runs (code, n).

    What falls into the others is one remaining child of its parent.
    """
    nodes = _nodes(grams)
    # a context is at least as frequent as what extends it, so its suffixes come with it
    kept = (
        nodes.groupBy("depth", "context").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "depth", "context").limit(contexts).select("depth", "context")
    )
    kept = materialize(kept)
    # at most contexts x 256 rows, whatever the corpus
    rows = (
        nodes.join(F.broadcast(kept), ["depth", "context"])
        .groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n")).toArrow()
    )
    d, c, s, n = (np.asarray(rows[x]).astype(np.int64) for x in ("depth", "context", "symbol", "n"))
    key, at = np.unique((d << 40) | c, return_inverse=True)
    known = [(int(k >> 40), int(k & ((1 << 40) - 1))) for k in key] or [(0, 0)]
    counts = np.zeros((len(known), 256))
    counts[at, s] = n
    return build_tree(known, counts)


def _log_gamma_of(x: Column) -> Column:
    """As ``_log_gamma``, of a column."""
    low = x
    for k in range(1, 8):
        low = low * (x + k)
    y = x + 8
    r = 1 / (y * y)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r / 1680))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(low)


_HALF = float(np.log(0.5))


def _with_kt(level: DataFrame) -> DataFrame:
    zeros, ones = F.col("zeros"), F.col("ones")
    kt = _log_gamma_of(zeros + 0.5) + _log_gamma_of(ones + 0.5) - _log_gamma_of(zeros + ones + 1.0) - float(np.log(np.pi))
    return level.withColumn("kt", F.when(zeros + ones > 0, kt).otherwise(0.0))


def _shorter(d: int) -> Column:
    """The context one byte shorter than those of depth ``d``."""
    return F.col("context").bitwiseAND(F.lit((1 << 8 * max(d - 1, 0)) - 1))


def _deepest(grams: DataFrame) -> DataFrame:
    """parent, context, symbol, n of byte runs (code, n), dealt by the parent of the context."""
    return grams.select(
        F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * (DEPTH - 1)) - 1)).alias("parent"),
        F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n",
    ).repartition("parent")


def _mix_deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, log10 from rows of a context, its symbols and what its parent says at each decision."""
    for b in batches:
        k = b.num_rows
        context = b.column(0).to_numpy()
        runs, said = b.column(1), b.column(2)
        of = np.repeat(np.arange(k), runs.value_lengths().to_numpy(zero_copy_only=False))
        symbol, n = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
        u, mixed, left = (x.to_numpy(zero_copy_only=False) for x in said.flatten().flatten())
        at = np.repeat(np.arange(k), said.value_lengths().to_numpy(zero_copy_only=False)) * 256 + u
        above, remains = np.full(k * 256, np.nan), np.full(k * 256, np.nan)
        above[at], remains[at] = mixed, left
        log10 = np.zeros(len(of))
        for step in range(8):
            cell = of * 256 + ((symbol | 256) >> (8 - step))
            bit = (symbol >> (7 - step)) & 1
            ones = np.bincount(cell, weights=n * bit, minlength=k * 256)[cell]
            total = np.bincount(cell, weights=n, minlength=k * 256)[cell]
            one = above[cell] + remains[cell] * (ones + 0.5) / (total + 1.0)
            log10 += np.log10(np.where(bit == 1, one, 1 - one))
        yield pa.RecordBatch.from_arrays([pa.array((context[of] << 8) | symbol), pa.array(log10)], ["code", "log10"])


def run_scores(grams: DataFrame) -> DataFrame:
    """code, log10: of every listed byte run (code, n) the log10 probability of its last byte.

    Only decisions with a listed run are rows; one without counts halves the probability at
    every context, as does a context that is not there.
    """
    n, bit = F.col("n"), F.col("bit")
    steps = F.array(
        *[
            F.struct(
                F.shiftright(F.col("symbol").bitwiseOR(F.lit(256)), 8 - b).alias("u"),
                F.shiftright("symbol", 7 - b).bitwiseAND(F.lit(1)).alias("bit"),
            )
            for b in range(8)
        ]
    )
    level = _with_kt(
        _deepest(grams).select("parent", "context", "n", F.inline(steps)).groupBy("parent", "context", "u")
        .agg(F.sum(n * (1 - bit)).alias("zeros"), F.sum(n * bit).alias("ones"))
    ).withColumn("weighted", F.col("kt"))
    levels: list[DataFrame] = []
    for _ in range(DEPTH):
        # every occurrence goes on to one child, so nothing remains beside the children
        above = _with_kt(
            level.groupBy(F.col("parent").alias("context"), "u")
            .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        )
        apart = F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below"))))
        above = materialize(above.withColumn("weighted", F.greatest("kt", "below") + apart + _HALF))
        levels.insert(0, above)
        level = above.withColumn("parent", _shorter(DEPTH - len(levels)))
    own = F.exp(F.col("kt") + _HALF - F.col("weighted")) * (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    left = F.exp(F.col("below") + _HALF - F.col("weighted"))
    # mixed: probability of 1 from the contexts so far; open: weight left to the deeper ones
    down = levels[0].select("context", "u", own.alias("mixed"), left.alias("open"))
    for d in range(1, DEPTH):
        here = levels[d].withColumn("parent", _shorter(d))
        down = here.join(down.withColumnRenamed("context", "parent"), ["parent", "u"]).select(
            "context", "u", (F.col("mixed") + F.col("open") * own).alias("mixed"), (F.col("open") * left).alias("open")
        )
    # at most 255 decisions and 256 symbols in a list
    said = down.groupBy(F.col("context").alias("parent")).agg(F.collect_list(F.struct("u", "mixed", "open")).alias("said"))
    runs = _deepest(grams).groupBy("parent", "context").agg(F.collect_list(F.struct("symbol", "n")).alias("runs"))
    return runs.join(said, "parent").select("context", "runs", "said").mapInArrow(_mix_deepest, "code bigint, log10 double")


_ZSTD = pa.Codec("zstd")


def _packed(low: np.ndarray, offsets: np.ndarray) -> bytes:
    """A run of texts for the shuffle: sizes, then what was compressed of offsets and bytes."""
    raw = offsets.tobytes() + low.tobytes()
    return np.array([len(offsets), len(raw)], np.int64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, size = np.frombuffer(data[:16], np.int64).tolist()
    raw = _ZSTD.decompress(data[16:], size, asbytes=True)
    return np.frombuffer(raw, np.uint8, offset=8 * k), np.frombuffer(raw, np.int64, k)


def block_scores(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """row, score of texts (block, row, packed) from the log10 probabilities of all their byte runs.

    ``packed`` stands on the first row of a run of texts and is null on the others.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        block = -1

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                code = np.unique(np.concatenate(held))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code)], ["block", "code"])

        for b in batches:
            blocks = b.column(0).to_numpy()
            for i in np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist():
                if blocks[i] != block:
                    yield from flush()
                    block = int(blocks[i])
                held.append(np.unique(gram_codes(*framed(*_unpacked(b.column(1)[i].as_py())))))
        yield from flush()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        # a block read by two tasks has listed a run twice
        code, at = np.unique(right.column("code").to_numpy(), return_index=True)
        log10 = right.column("log10").to_numpy()[at]
        rows, scores = [np.empty(0, np.int64)], [np.empty(0)]
        for row, data in zip(left.column("row").to_pylist(), left.column("packed"), strict=True):
            low, offsets = _unpacked(data.as_py())
            logs = log10[np.searchsorted(code, gram_codes(*framed(low, offsets)))]
            ends = np.cumsum(np.diff(offsets) + 1)
            scores.append(np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])))
            rows.append(row + np.arange(len(ends)))
        return pa.table({"row": np.concatenate(rows), "score": np.concatenate(scores)})

    used = texts.select("block", "packed").mapInArrow(listed, "block bigint, code bigint")
    return (
        texts.where(F.col("packed").isNotNull()).select("block", "row", "packed").groupBy("block")
        .cogroup(used.join(runs, "code").groupBy("block"))
        .applyInArrow(scored, "row bigint, score double")
    )


def text_scores(tree: Tree, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log10 probability of each text, its end included."""
    data, at = framed(low, offsets)
    k = len(tree.log10)
    state = np.zeros(len(at), np.int64)
    flat = tree.step.ravel()
    for back in range(1, DEPTH + 1):
        state = flat[state * 256 + data[at - back]].astype(np.int64)
    state[state >= k] -= k
    logs = tree.log10.ravel()[state * 256 + data[at]].astype(np.float64)
    ends = np.cumsum(np.diff(offsets) + 1)
    return np.diff(np.concatenate([[0.0], np.cumsum(logs)[ends - 1]])) if len(ends) else np.empty(0)


def score_corpus(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that ``held_out`` (a function of the id column) does not name. A null
    text is empty: one token, its end. Repeated rows count and are scored each. Without any
    training row every count is 0. An empty table gives no rows. ``bits_per_byte`` follows the
    asked columns: the code length of ``score`` (its end included) for each byte.
    """
    counts = materialize(count_corpus(docs, text, ~held_out(F.col(key))))
    grams = counts.where(F.col("kind") == GRAM).select("code", "n")
    taught = grams.where(F.col("n") > 0)
    contexts = _nodes(taught).select("depth", "context").distinct().limit(CONTEXTS + 1).count()
    tree = learn(taught, CONTEXTS) if contexts <= CONTEXTS else None
    vocabulary = counts.where(F.col("kind") == WORD).select(F.col("code").alias("word"), "n")
    seen = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    trained = docs.where(~held_out(F.col(key))).count()
    total, distinct = (seen[0] or 0) + trained, seen[1] + (trained > 0)
    top = vocabulary.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    word, often = (np.asarray(top[c]).astype(np.int64) for c in ("word", "n"))
    order = np.argsort(word)
    # bounded by CONTEXTS and FREQUENT
    shared = docs.sparkSession.sparkContext.broadcast((tree, word[order], np.log10(often[order] + 1.0)))
    kind = docs.schema[key].dataType.simpleString()
    rows = materialize(
        docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
            _scoring(shared, trained),
            f"doc_id {kind}, row bigint, n_bytes bigint, n_tokens bigint, known bigint, logs double, score double, "
            "words array<bigint>, times array<int>, block bigint, packed binary",
        )
    )
    # what no task knew: words below the frequent ones
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times")
    )
    found = (
        rare.join(vocabulary, "word").groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    zero = F.lit(0)
    each = float(np.log10(total + distinct + 1.0))
    each_row = rows.drop("words", "times", "block", "packed")
    if tree is None:
        each_row = each_row.drop("score").join(block_scores(rows, run_scores(grams)), "row")
    return each_row.join(found, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _scoring(shared, trained: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, frequent, frequent_logs = shared.value
        row = block = TaskContext.get().partitionId() << 40
        filled = 0
        for b in batches:
            for first, stop, body, offsets in pieces(b.column(1)):
                n = stop - first
                if filled + len(body) > BLOCK_BYTES:
                    block, filled = row, 0
                filled += len(body)
                low = LOWER[body]
                s, e, of = words(low, offsets, SPACED)
                h = word_hashes(low, s, e).view(np.int64)
                n_tokens = np.bincount(of, minlength=n) + 1
                known = np.full(n, int(trained > 0))
                logs = np.full(n, np.log10(trained + 1.0))
                if len(frequent):
                    near = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    hit = frequent[near] == h
                    known += np.bincount(of[hit], minlength=n)
                    logs += np.bincount(of[hit], weights=frequent_logs[near[hit]], minlength=n)
                    h, of = h[~hit], of[~hit]
                cuts = np.searchsorted(of, np.arange(n + 1))
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    h[a:z].sort()
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(h)))
                cuts = np.searchsorted(of[starts], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, n),
                        pa.array(np.arange(row, row + n)),
                        pa.array(np.diff(offsets)),
                        pa.array(n_tokens),
                        pa.array(known),
                        pa.array(logs),
                        pa.nulls(n, pa.float64()) if tree is None else pa.array(text_scores(tree, low, offsets)),
                        pa.ListArray.from_arrays(cuts, h[starts]),
                        pa.ListArray.from_arrays(cuts, times.astype(np.int32)),
                        pa.array(np.full(n, block)),
                        pa.array([_packed(low, offsets) if tree is None else None] + [None] * (n - 1), pa.binary()),
                    ],
                    ["doc_id", "row", "n_bytes", "n_tokens", "known", "logs", "score", "words", "times", "block", "packed"],
                )
                row += n

    return run
