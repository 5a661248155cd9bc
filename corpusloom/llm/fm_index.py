"""Benchmark decontamination by an FM-index of every shard of the training text.

A shard is a run of documents in one Arrow task. Its words become symbols of the benchmark's
vocabulary; words that no benchmark text uses only separate runs. The shard's suffixes are
sorted, the Burrows-Wheeler symbols go into a wavelet matrix, all benchmark windows are found
at once by backward search, and occurrences are located by walking to sampled suffix
positions. Overlapping occurrences merge into removal spans. Documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packed_text import LETTERS, LOWER, pieces, word_hashes, words

WINDOW = 13
SHARD_WORDS = 1 << 20
SAMPLE = 16
#: Bytes of text that make a shard.
SHARD_BYTES = 1 << 20
#: Benchmark text that one pass may hold; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20


@dataclass
class Patterns:
    vocabulary: np.ndarray  # sorted word hashes; symbol = position + 1
    windows: np.ndarray  # symbols, right-aligned, 0 on the left of shorter ones
    lengths: np.ndarray
    item_start: np.ndarray  # window w belongs to item_of[item_start[w]:item_start[w + 1]]
    item_of: np.ndarray


def patterns(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Patterns:
    """Distinct windows of all items. Items without a word have none."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    hashes, owner = [], []
    for first, _, body, offsets in pieces(texts):
        low = LOWER[body]
        s, e, of = words(low, offsets, LETTERS)
        hashes.append(word_hashes(low, s, e))
        owner.append(of + first)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    of = np.concatenate(owner) if owner else np.empty(0, np.int64)
    vocabulary, symbol = np.unique(h, return_inverse=True)
    seen: dict[tuple, set] = {}
    cuts = np.searchsorted(of, np.arange(len(items) + 1))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        run = (symbol[a:b] + 1).tolist()
        for k in range(max(len(run) - window, 0) + 1):
            if w := tuple(run[k : k + window]):
                seen.setdefault(w, set()).add(i)
    table = np.zeros((len(seen), window), np.int64)
    lengths = np.zeros(len(seen), np.int64)
    starts, owners = [0], []
    for k, (w, own) in enumerate(seen.items()):
        table[k, window - len(w) :] = w
        lengths[k] = len(w)
        owners += sorted(own)
        starts.append(len(owners))
    return Patterns(vocabulary, table, lengths, np.array(starts), np.array(owners, np.int64))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; every 0 ends a run and counts as a symbol of its own, in text order.

    The first pass sorts by as many symbols as fit 62 bits, later passes double the depth for
    suffixes that are still tied. The last symbol must be 0.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + ends.sum() - 1)
    bits = max(1, int(rank.max()).bit_length())
    depth = max(1, 62 // bits)
    key = rank.copy()
    for k in range(1, depth):
        key <<= bits
        if k < n:
            key[: n - k] |= rank[k:]
    sa = np.argsort(key, kind="stable")
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = key[sa[1:]] != key[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    while True:
        at = np.flatnonzero(~(fresh[:n] & fresh[1:]))
        if not len(at):
            return sa
        tied = sa[at]
        after = rank[np.minimum(tied + depth, n - 1)]
        order = np.lexsort((after, rank[tied]))
        tied, after, group = tied[order], after[order], rank[tied][order]
        sa[at] = tied
        apart = np.ones(len(at), bool)
        apart[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        fresh[at] = apart
        rank[tied] = np.maximum.accumulate(np.where(apart, at, 0))
        depth *= 2


class WaveletMatrix:
    """Rank and access over a symbol sequence, one bit vector a level."""

    def __init__(self, values: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``place``."""
        at, base = place, np.zeros_like(place)
        for k, before in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            zeros_at, zeros_base, total = before[at], before[base], before[-1]
            at = np.where(one, total + at - zeros_at, zeros_at)
            base = np.where(one, total + base - zeros_base, zeros_base)
        return at - base

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros_like(place), place
        for before in self.zeros:
            here = before[at]
            one = before[at + 1] == here
            symbol = symbol * 2 + one
            at = np.where(one, before[-1] + at - here, here)
        return symbol


class FmIndex:
    """Count and locate runs of symbols in one shard."""

    def __init__(self, symbols: np.ndarray, largest: int):
        sa = suffix_array(symbols)
        before = np.where(sa > 0, symbols[sa - 1], 0)
        self.tree = WaveletMatrix(before, largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        kept = (sa % SAMPLE == 0) | (before == 0)  # run starts too: no step crosses a 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = sa[kept]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of all windows, by backward search: window number, first row, end."""
        live = np.arange(len(windows))
        last = windows[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for step in range(1, windows.shape[1] + 1):
            some = high > low
            live, low, high = live[some], low[some], high[some]
            if step == windows.shape[1] or not len(live):
                break
            on = lengths[live] > step
            c = windows[live[on], -1 - step]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            r = rows[open_]
            done = self.kept_before[r + 1] > self.kept_before[r]
            found[open_[done]] = self.sampled[self.kept_before[r[done]]] + steps
            open_, r = open_[~done], r[~done]
            c = self.tree.access(r)
            rows = rows.copy() if not steps else rows
            rows[open_] = self.first[c] + self.tree.rank(c, r)
            steps += 1
        return found


def occurrences(symbols: np.ndarray, known: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Start (index into ``symbols``) and window of every occurrence in one shard.

    Runs of 0 shrink to one before the index is built.
    """
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    places = np.flatnonzero(keep)
    text = np.append(symbols[places], 0)
    if not len(known.windows) or not text.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = FmIndex(text, len(known.vocabulary))
    window, low, high = index.search(known.windows, known.lengths)
    many = high - low
    rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    return places[index.locate(rows)], np.repeat(window, many)


def scan(texts: pa.Array, known: Patterns) -> Iterator[tuple[int, np.ndarray, list, list]]:
    """For runs of rows: first row, word counts, hit spans of each row, item numbers of each row."""
    longest = known.windows.shape[1]
    for first, stop, body, offsets in pieces(texts, SHARD_BYTES):
        n = stop - first
        low = LOWER[body]
        s, e, of = words(low, offsets, LETTERS)
        n_words = np.bincount(of, minlength=n)
        symbols = np.zeros(len(s) + n, np.int64)  # one 0 after every text
        at_word = np.arange(len(s)) + of
        if len(known.vocabulary):
            h = word_hashes(low, s, e)
            near = np.minimum(np.searchsorted(known.vocabulary, h), len(known.vocabulary) - 1)
            symbols[at_word] = np.where(known.vocabulary[near] == h, near + 1, 0)
        starts, which = [], []
        for a in range(0, max(len(symbols), 1), SHARD_WORDS):
            # shards overlap, so that no window is cut
            p, w = occurrences(symbols[a : a + SHARD_WORDS + longest - 1], known)
            starts.append(p + a)
            which.append(w)
        at, window = np.concatenate(starts), np.concatenate(which)
        steps = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + known.lengths[window], -1)
        covered = np.cumsum(steps[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
        begin, end = edges[::2], edges[1::2]
        text_first = np.concatenate([[0], np.cumsum(n_words + 1)])
        text = np.searchsorted(text_first, begin, "right") - 1
        spans: list[list] = [[] for _ in range(n)]
        for t, b, x in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
            spans[t].append((b - int(text_first[t]), x - int(text_first[t])))
        items: list[set] = [set() for _ in range(n)]
        pair = np.unique((np.searchsorted(text_first, at, "right") - 1) * max(len(known.windows), 1) + window)
        for p in pair.tolist():
            t, w = divmod(p, max(len(known.windows), 1))
            items[t].update(known.item_of[known.item_start[w] : known.item_start[w + 1]].tolist())
        yield first, n_words, spans, items


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    keep: tuple[str, ...] = (),
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, the columns ``keep``, n_words, spans, items.

    ``with_text`` adds ``text`` (null as empty), which has been through the tasks anyway.

    ``spans`` are the removal spans, array of (start, end) in words, merged and sorted;
    ``items`` the distinct ids (as strings, sorted) of items with a window in the text. A
    window is ``window`` consecutive item words, or a shorter item whole. Null and empty texts
    have no words; items without words or id name nothing (without an id they still mark
    spans); repeated rows are searched each; an empty table gives no rows, an empty benchmark
    no spans. The benchmark is measured and searched in passes of at most about ``pass_bytes``.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    passes = int(size // pass_bytes) + 1
    kind = docs.schema[key].dataType.simpleString()
    df = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        *keep,
    )
    schema = f"doc_id {kind}, text string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    slot = F.pmod(F.xxhash64(text), F.lit(passes))
    for k in range(passes):
        # a pass is bounded by pass_bytes on average; one item is never cut
        part = benchmark.select(F.col(item).cast("string"), text).where(F.col(text).isNotNull() & (slot == k))
        rows = [(r[0], r[1]) for r in part.collect()]
        shared = spark.sparkContext.broadcast((patterns(rows, window), [r[0] for r in rows]))
        df = df.mapInArrow(_searching(shared, first_pass=k == 0, blank=k == passes - 1 and not with_text), schema)
    return df.select("doc_id", *keep, *(["text"] if with_text else []), "n_words", "spans", "items")


def _searching(shared, first_pass: bool, blank: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = shared.value
        for b in batches:
            ids, texts, _, spans, items, *kept = b.columns
            for first, n_words, new_spans, new_items in scan(texts, known):
                n = len(n_words)
                if first_pass:
                    old_spans, old_items = [[]] * n, [[]] * n
                else:
                    old_spans, old_items = spans.slice(first, n).to_pylist(), items.slice(first, n).to_pylist()
                merged = [_merge(o, m) for o, m in zip(old_spans, new_spans, strict=True)]
                named = [
                    sorted({*o, *(names[i] for i in m if names[i] is not None)})
                    for o, m in zip(old_items, new_items, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        pa.array([""] * n, pa.string()) if blank else texts.slice(first, n),
                        pa.array(n_words, pa.int64()),
                        pa.array(merged, spans.type),
                        pa.array(named, items.type),
                        *[c.slice(first, n) for c in kept],
                    ],
                    names=b.schema.names,
                )

    return run


def _merge(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    """Union of two sorted lists of spans; touching spans become one."""
    out: list[list[int]] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]
