"""Phrase collocations from sorted count streams.

Every word position gives one window of up to five words. The windows of a few MB of text are
counted, sorted and dealt out as blocks to ranges of the prefix order. A range merges its blocks
into one stream, in which the count of each phrase is the sum of one run; the runs of all lengths
are read off together. What is frequent enough forms a second, small stream. One
pass over it in prefix order meets every phrase after its own first parts (left counts) and before
its continuations (extensions to the right); one pass in suffix order, words reversed, does the
same for last parts and extensions to the left. Merging the two streams gives all counts a score
needs. No table of phrases is held in memory: a pass keeps one open run for each length.

Ranges are cut from sampled keys, so neither a hot word nor a hot phrase is a partition. Where a run crosses a border, the two sides are put together afterwards; that is a
handful of rows for each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.llm.packed_text import LOWER, byte_class, pieces, words
from corpusloom.operators.ordering import with_row_ids
from corpusloom.runtime import materialize

LONGEST = 5
LEAST = 100
TOP = 2000
#: Frequent words sent to every task; a longer list is joined instead.
VOCABULARY_BYTES = 64 << 20
RUN_BYTES = 4 << 20
#: Windows of a range, which one task merges, and keys sampled to find the ranges.
RANGE_WINDOWS = 1 << 19
SAMPLE_KEYS = 1 << 17
BLOCK_WINDOWS = 1 << 16
_SPOTS = 64

_STOPS = [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]
_WORD = byte_class((0x20, 0x20), (0x09, 0x0D), *[(s, s) for s in _STOPS])
_STOP = np.zeros(256, bool)
_STOP[_STOPS] = True


def _cut_long(body: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """Offsets with texts beyond ``limit`` bytes cut after a stop, where a phrase ends anyway."""
    if len(offsets) != 2 or offsets[1] <= limit:
        return offsets
    stops = np.flatnonzero(_STOP[body]) + 1
    at = np.searchsorted(stops, np.arange(limit, len(body), limit), "right") - 1
    return np.unique(np.concatenate([offsets, stops[at[at >= 0]]]))


def _word_runs(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list]]:
    """For runs of texts: words, language code of each, whether it opens a piece, languages."""
    coded = langs.dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    for first, stop, body, offsets in pieces(texts, RUN_BYTES):
        low = LOWER[body]
        cut = _cut_long(low, offsets, RUN_BYTES)
        row = np.searchsorted(offsets, cut[:-1], "right") - 1
        for a, z in _spans(cut):
            part = low[cut[a] : cut[z]]
            starts, ends, of = words(part, cut[a : z + 1] - cut[a], _WORD)
            if not len(starts):
                continue
            piece = np.cumsum(_STOP[part], dtype=np.int32)[starts]
            opens = np.ones(len(starts), bool)
            opens[1:] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
            inside = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            # the bytes of all words, one after the other
            step = np.repeat(starts - inside[:-1], ends - starts)
            flat = part[np.arange(inside[-1]) + step]
            tokens = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(inside), pa.py_buffer(flat)])
            yield tokens, codes[first + row[a + of]], opens, names


def _spans(cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``RUN_BYTES`` together."""
    a = 0
    while a < len(cut) - 1:
        z = max(int(np.searchsorted(cut, cut[a] + RUN_BYTES, "right")) - 1, a + 1)
        yield a, z
        a = z


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens, lang, _, names in _word_runs(batch.column(0), batch.column(1)):
            coded = tokens.dictionary_encode()
            width = len(coded.dictionary)
            seen, n = np.unique(lang.astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()).take(pa.array(seen // width)),
                    coded.dictionary.take(pa.array(seen % width)),
                    pa.array(n, pa.int64()),
                ],
                ["lang", "word", "n"],
            )


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, word, n)`` of all words; a null language is ``und``."""
    return (
        _texts(docs, lang, text)
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(
        F.col("text").isNotNull()
    )


# --- words to numbers ----------------------------------------------------------------


def _joined(ids: np.ndarray, opens: np.ndarray) -> bytes:
    """Numbers of one run; 0 stands between pieces and for words that are not frequent."""
    out = np.zeros(len(ids) + int(opens.sum()), np.int32)
    out[np.arange(len(ids)) + np.cumsum(opens)] = ids
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    return out[keep].tobytes()


def _encode_by_lookup(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Numbers of the words in the scan of the texts, from the sent vocabulary."""
    held = vocabulary.select("lang", "word", "id").toArrow()
    by_lang: dict[str, tuple[pa.Array, np.ndarray]] = {}
    for name in pc.unique(held["lang"]).to_pylist():
        part = held.filter(pc.equal(held["lang"], name))
        by_lang[name] = part["word"].combine_chunks(), part["id"].to_numpy().astype(np.int32)
    shared = texts.sparkSession.sparkContext.broadcast(by_lang)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for tokens, lang, opens, names in _word_runs(batch.column(0), batch.column(1)):
                coded = tokens.dictionary_encode()
                word = coded.indices.to_numpy()
                ids = np.zeros(len(word), np.int32)
                for code in np.unique(lang):
                    if names[code] in known:
                        listed, numbers = known[names[code]]
                        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=listed), -1).to_numpy()
                        number = np.where(at >= 0, numbers[at], 0)
                        mine = lang == code
                        ids[mine] = number[word[mine]]
                yield pa.RecordBatch.from_arrays([pa.array([_joined(ids, opens)], pa.binary())], ["ids"])

    return texts.mapInArrow(encode, "ids binary")


def _encode_by_join(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size: each run asks for its distinct words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        for batch in batches:
            for tokens, lang, opens, names in _word_runs(batch.column(0), batch.column(1)):
                coded = tokens.dictionary_encode()
                width = len(coded.dictionary)
                key = lang.astype(np.int64) * width + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                seen, first = np.unique(key[order], return_index=True)
                places = (np.arange(len(key)) + np.cumsum(opens)).astype(np.int32)[order]
                ends = np.append(first, len(key)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(seen), run, np.int64)),
                        pa.array(names, pa.string()).take(pa.array(seen // width)),
                        coded.dictionary.take(pa.array(seen % width)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(places)),
                    ],
                    ["run", "lang", "word", "at"],
                )
                run += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words_of in batch.column(0).to_pylist():
                ids = np.zeros(max(w["at"][-1] for w in words_of) + 1, np.int32)
                for w in words_of:
                    ids[w["at"]] = w["id"]
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    asked = texts.mapInArrow(ask, "run long, lang string, word string, at array<int>")
    known = asked.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    runs = known.groupBy("run").agg(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "at")).alias("w"))
    return runs.select("w").mapInArrow(answer, "ids binary")


# --- the stream of windows -----------------------------------------------------------


def _keys(ids: np.ndarray, width: int) -> pa.Array:
    """Rows of word numbers as binary keys: ``width`` bytes a word, 0 ends a row.

    Byte order of the keys is prefix order.
    """
    raw = _raw(ids, width)
    size = (ids > 0).sum(1) * width
    flat = raw[np.arange(raw.shape[1]) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _windows_of(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of two words or more in prefix order, and their counts."""
    padded = np.concatenate([ids, np.zeros(longest, np.int32)])
    two = np.flatnonzero((padded[: len(ids)] > 0) & (padded[1 : len(ids) + 1] > 0))
    rows = padded[two[:, None] + np.arange(longest)]
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def _raw(ids: np.ndarray, width: int) -> np.ndarray:
    """Word numbers as ``width`` bytes each, big end first: byte order is prefix order."""
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(*ids.shape, 4)
    return np.ascontiguousarray(wide[:, :, 4 - width :]).reshape(len(ids), ids.shape[1] * width)


def _unraw(raw: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(raw), raw.shape[1] // width, 4), np.uint8)
    wide[:, :, 4 - width :] = raw.reshape(len(raw), -1, width)
    return wide.view(">u4")[:, :, 0].astype(np.int32)


def _sample(width: int, longest: int):
    """Arrow function: a few windows of each run, evenly spaced, and how many it has."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                rows, _ = _windows_of(np.frombuffer(held.as_buffer(), np.int32), longest)
                if len(rows):
                    spot = np.unique(np.linspace(0, len(rows) - 1, _SPOTS).astype(np.int64))
                    many = np.zeros(len(spot), np.int64)
                    many[0] = len(rows)
                    salt = np.arange(len(spot)) + zlib.crc32(held.as_buffer())
                    yield pa.RecordBatch.from_arrays(
                        [_keys(rows[spot], width), pa.array(salt), pa.array(many)], ["key", "salt", "n"]
                    )

    return draw


def range_borders(encoded: DataFrame, width: int, longest: int) -> np.ndarray:
    """Keys that cut the windows into ranges of about ``RANGE_WINDOWS``, from a bounded sample."""
    seen = Observation()
    spots = encoded.mapInArrow(_sample(width, longest), "key binary, salt long, n long").observe(seen, F.sum("n").alias("n"))
    drawn = spots.select("key", F.xxhash64("key", "salt").alias("_mix")).orderBy("_mix").limit(SAMPLE_KEYS).toArrow()
    keys = sorted(drawn["key"].to_pylist())
    ranges = min(max((seen.get["n"] or 0) // RANGE_WINDOWS, 1), max(len(keys), 1))
    cut = [keys[len(keys) * r // ranges] for r in range(1, ranges)]
    return np.unique(np.array(cut, f"S{width * longest}"))


def _dealt(width: int, longest: int, borders: np.ndarray):
    """Arrow function: the windows of each run, counted and sorted, as one block for each range."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                rows, n = _windows_of(np.frombuffer(held.as_buffer(), np.int32), longest)
                raw = _raw(rows, width)
                cut = np.searchsorted(raw.view(f"S{width * longest}")[:, 0] if len(raw) else np.empty(0, "S1"), borders)
                cut = np.concatenate([[0], cut, [len(rows)]])
                into = np.flatnonzero(np.diff(cut))
                blocks = [
                    # byte planes of a sorted block are long runs
                    (int(r), np.ascontiguousarray(raw[a:z].T).tobytes(), n[a:z].astype(np.int32).tobytes())
                    for r in into
                    for a in range(cut[r], cut[r + 1], BLOCK_WINDOWS)
                    for z in [min(a + BLOCK_WINDOWS, cut[r + 1])]
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.binary(), pa.binary()))]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, ["range", "windows", "counts"])

    return deal


def _run_sums(width: int, longest: int, least: int):
    """Arrow function over blocks sorted by range: ``(key, n)`` of phrases of two words or more.

    The blocks of a range are merged into one stream. A run that may go on beyond the border of
    the range is given whatever its count.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for place, windows, counts in rows:
                if place != at and held:
                    yield merged(held)
                    held = []
                at = place
                held.append((windows, np.frombuffer(counts, np.int32)))
        if held:
            yield merged(held)

    def merged(blocks: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        n = np.concatenate([c for _, c in blocks]).astype(np.int64)
        raw = np.concatenate([np.frombuffer(w, np.uint8).reshape(longest * width, -1).T for w, _ in blocks])
        ids = _unraw(raw, width)
        order = np.lexsort(ids.T[::-1])
        ids, n = ids[order], n[order]
        differs = np.ones(ids.shape, bool)
        differs[1:] = ids[1:] != ids[:-1]
        changed = np.logical_or.accumulate(differs, axis=1)
        keys, counts = [], []
        for m in range(2, longest + 1):
            starts = np.flatnonzero(changed[:, m - 1])
            total = np.add.reduceat(n, starts)
            given = total >= least
            given[[0, -1]] = True
            given &= ids[starts, m - 1] > 0
            found = ids[starts[given]]
            found[:, m:] = 0
            keys.append(found)
            counts.append(total[given])
        return pa.RecordBatch.from_arrays(
            [_keys(np.concatenate(keys), width), pa.array(np.concatenate(counts), pa.int64())], ["key", "n"]
        )

    return sums


def _in_order(stream: DataFrame, key: str) -> DataFrame:
    return stream.repartitionByRange(key).sortWithinPartitions(key)


def phrase_counts(encoded: DataFrame, width: int, longest: int, least: int) -> DataFrame:
    """``(key, n)`` of all phrases of two to ``longest`` frequent words that occur ``least`` times."""
    borders = range_borders(encoded, width, longest)
    blocks = encoded.mapInArrow(_dealt(width, longest, borders), "range int, windows binary, counts binary")
    streams = blocks.repartition(len(borders) + 1, "range").sortWithinPartitions("range")
    runs = streams.mapInArrow(_run_sums(width, longest, least), "key binary, n long")
    return runs.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- one pass in prefix or suffix order ----------------------------------------------

_REAL, _BEYOND = 0, 1
_PASS = "key binary, n long, parts array<long>, longer long, kind int, task int, first boolean"


def _nested(width: int):
    """Arrow function over phrases in order: counts of first parts, and the most frequent extension.

    The open phrases are a stack, each the first part of the next. Parts before the border are
    unknown (null) and get a row of kind ``_BEYOND`` for the extensions seen here.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        stack: list[list] = []  # key, n, counts of first parts, longer, kind, first row of the task
        done: list[list] = []
        first = True

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_()]
            key, n, parts, longer, kind, lead = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
            done.clear()
            tasks = pa.array(np.full(len(key), task, np.int32))
            names = ["key", "n", "parts", "longer", "kind", "task", "first"]
            return pa.RecordBatch.from_arrays([key, n, parts, longer, kind, tasks, lead], names)

        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first:
                    for k in range(width, len(key), width):
                        stack.append([key[:k], None, [None] * (k // width - 1), 0, _BEYOND, False])
                while stack and not key.startswith(stack[-1][0]):
                    done.append(stack.pop())
                if stack:
                    above = stack[-1]
                    above[3] = max(above[3], n)
                    parts = [*above[2], above[1]]
                else:
                    parts = []
                stack.append([key, n, parts, 0, _REAL, first])
                first = False
            yield flush()
        done.extend(stack)
        yield flush()

    return walk


def nested_counts(phrases: DataFrame, width: int) -> DataFrame:
    """``(key, n, parts, longer)`` for ``phrases(key, n)`` that holds all first parts of its keys.

    ``parts`` are the counts of the first 1, 2, ... words, ``longer`` the count of the most
    frequent phrase with one more word behind, 0 if there is none.
    """
    walked = materialize(_in_order(phrases, "key").mapInArrow(_nested(width), _PASS))
    # a few rows a task: the first parts of its first phrase, and extensions of phrases before it
    lead = walked.where("first").select(
        "task",
        F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("key") / width - 1, F.lit(1)).cast("int"))).alias("m"),
        "key",
    ).where(F.col("m") * width < F.octet_length("key"))
    part = F.substring("key", F.lit(1), F.col("m") * width)
    wanted = lead.select("task", "m", part.alias("key"))
    ahead = phrases.join(F.broadcast(wanted), "key").groupBy("task").agg(
        F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("ahead")
    )
    more = walked.where(F.col("kind") == _BEYOND).groupBy("key").agg(F.max("longer").alias("more"))
    filled = F.transform("parts", lambda n, i: F.coalesce(n, F.col("ahead")[i + 1]))
    return (
        walked.where(F.col("kind") == _REAL)
        .join(F.broadcast(ahead), "task", "left")
        .join(F.broadcast(more), "key", "left")
        .select("key", "n", filled.alias("parts"), F.greatest("longer", "more").alias("longer"))
    )


def _reversed_key(key: str, width: int, longest: int) -> Column:
    """The words of a key from last to first."""
    steps = [F.substring(key, 1 + k * width, width) for k in reversed(range(longest))]
    return F.concat(*steps)


def association_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))`` in exact arithmetic of 38 digits."""
    whole = "decimal(19,0)"
    return F.call_function(
        "div", (a * 1000).cast(whole) * n.cast(whole), left.cast(whole) * right.cast(whole)
    ).cast("long")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words
    at spaces and tabs. Phrases are two to ``longest`` words of one piece that occur at least
    ``least`` times in a language (null is ``und``, together with rows that say so). A phrase is
    scored at its weakest cut, ties going to the cut nearest its start, and dropped when some
    phrase with one word more occurs as often. Ranks are dense by score, count, then phrase in
    UTF-8 byte order. A null or empty text has no words; repeated rows count each; texts of any
    length are read whole. Other columns are ignored. An empty table, or one without a frequent
    phrase, gives no rows.
    """
    texts = _texts(docs, lang, text)
    counts = materialize(word_counts(docs, lang, text))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= least).withColumnRenamed("n", "a")
    vocabulary = materialize(
        with_row_ids(frequent, ["lang", "word"], "_at").select("lang", "word", "a", (F.col("_at") + 1).alias("id"))
    )
    size, many = vocabulary.agg(
        F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + 16), F.lit(0)), F.count(F.lit(1))
    ).first()
    width = max(1, (many.bit_length() + 7) // 8)
    encode = _encode_by_lookup if size <= vocabulary_bytes else _encode_by_join
    encoded = materialize(encode(texts, vocabulary))

    single = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    phrases = materialize(
        phrase_counts(encoded, width, longest, least).unionByName(vocabulary.select(single.alias("key"), F.col("a").alias("n")))
    )
    forward = nested_counts(phrases, width)
    mirrored = phrases.select(_reversed_key("key", width, longest).alias("key"), "n")
    backward = nested_counts(mirrored, width).select(
        _reversed_key("key", width, longest).alias("key"),
        F.col("parts").alias("tails"),
        F.col("longer").alias("before"),
    )
    merged = forward.hint("merge").join(backward, "key").where(
        (F.octet_length("key") > width) & (F.greatest("longer", "before") < F.col("n"))
    )
    first = F.conv(F.hex(F.substring("key", 1, width)), 16, 10).cast("long")
    placed = merged.withColumnRenamed("n", "a").withColumn("id", first).join(vocabulary.select("id", "lang"), "id").join(totals, "lang")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda k: F.struct(
            association_score(F.col("a"), F.col("n"), F.col("parts")[k - 1], F.col("tails")[F.size("parts") - k]).alias("score"),
            k.alias("k"),
            F.col("parts")[k - 1].alias("l"),
            F.col("tails")[F.size("parts") - k].alias("r"),
        ),
    )
    scored = placed.withColumn("cut", F.array_min(cuts)).select("lang", "key", "a", "n", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a")]
    leading = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("_rank") <= top)
    spelled = (
        leading.select("*", F.posexplode(F.sequence(F.lit(0), (F.octet_length("key") / width - 1).cast("int"))).alias("at", "_"))
        .withColumn("id", F.conv(F.hex(F.substring("key", F.col("at") * width + 1, F.lit(width))), 16, 10).cast("long"))
        .join(vocabulary.select("id", "word"), "id")
        .groupBy("lang", "key", "a", "l", "r", "n", "score")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    ranked = Window.partitionBy("lang").orderBy(*best, "phrase")
    return (
        spelled.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
