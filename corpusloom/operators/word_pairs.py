"""Counts of word pairs inside a window, kept small between the tasks.

Tokens are numbered once: the rows of a batch become one block, their distinct words and the number
of each token, and every later pass reads these blocks. The same pass bounds, for every word, the pairs it can lead and the pairs it can end; a word that
stays under the least count on both sides is left out. A task numbers the other words of a block
of tokens, sorts the pairs of the block and hands on each distinct pair once. Pairs of two words
of a shared word list are cut into ranges of their order and travel as compressed differences.
Words left that the list has no room for are marked by their hash; pairs with one of them travel as
words, dealt by a hash of both. So a pair takes a few bytes, and every part is summed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.raw_words import clean_codes
from corpusloom.functions.stopwords import stop_words
from corpusloom.runtime import materialize

_LIST_WORDS = 1 << 21  # the most frequent words, sent to every task (some 32 MB)
_BITS = 21
_MARKS = 1 << 27  # bits that mark words off the list, sent to every task (16 MB)
_PAGE = 1 << 20  # bits put together at once
_BLOCK_TOKENS = 1 << 20
_BLOCK_BYTES = 1 << 24  # tokens or text numbered at once
_HEADS = 1 << 15  # places whose pairs are sorted at once
_PART_PAIRS = 1 << 22  # pairs of one part, before equal ones are summed
_SLICE_PAIRS = 1 << 20  # pairs that leave a task as words in one batch
_ROW = pa.schema([
    ("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()),
    ("word1", pa.list_(pa.string())), ("word2", pa.list_(pa.string())), ("n", pa.list_(pa.int64())),
])
_BYTES = ("words", "sums", "codes", "sizes")
_BLOCK = pa.struct([("n", pa.int64()), *((f, pa.binary()) for f in _BYTES)])
_BLOCK_TYPE = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(f, T.BinaryType()) for f in _BYTES)])
_SUMS = ("frequency", "leads", "ends")
_WORDS_TYPE = "part int, words binary"
_PART_WORDS = 1 << 22  # tokens whose words make one part
_ROW_TYPE = "part int, pairs binary, counts binary, word1 array<string>, word2 array<string>, n array<long>"


def _coded(column: pa.Array, stop: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each token, the words numbered, and the number of tokens of each row.

    A column of texts is cleaned and split first. Null tokens have the number -1.
    """
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return clean_codes(column.cast(pa.string()), stop)
    if column.type != pa.list_(pa.string()):
        column = column.cast(pa.list_(pa.string()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, sizes


def _written(batch: pa.RecordBatch) -> bytes:
    """A batch as bytes, which Spark passes on as they are."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _edge_words(codes: np.ndarray, words: pa.Array, sizes: np.ndarray, reach: int) -> list[pa.Array]:
    """The first and the last ``reach`` tokens of every row."""
    ends = np.cumsum(sizes)
    few = np.minimum(sizes, reach)
    offsets = np.r_[0, np.cumsum(few)]
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], few)
    found = []
    for starts in (ends - sizes, ends - few):
        some = codes[np.repeat(starts, few) + inside]
        found.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(some, mask=some < 0))))
    return found


def number_tokens(df: DataFrame, tokens: str, reach: int, order: list | None = None, language: str = "english") -> DataFrame:
    """``_block`` holds the numbered tokens of many rows, in the first of them, and the sums of their words.

    ``tokens`` are lists of words, or texts to be cleaned and split as ``clean_tokens`` does. With
    ``order`` every row keeps these columns and its first and last ``reach`` tokens, ``_head`` and ``_tail``.
    """
    stop = list(stop_words(language))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(tokens).nbytes
            if size >= _BLOCK_BYTES:
                yield row(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield row(pa.Table.from_batches(held))

    def row(table: pa.Table) -> pa.RecordBatch:
        codes, words, sizes = _coded(table[tokens].combine_chunks(), stop)
        rest = pa.nulls(len(table) - 1 if order and len(table) else 0, _BLOCK)
        block = pa.StructArray.from_arrays([
            pa.array([int((codes >= 0).sum())]), pa.array([_written(pa.record_batch([words], ["word"]))]),
            pa.array([_written(pa.record_batch(_word_sums(codes, sizes, len(words), reach), _SUMS))]),
            pa.array([codes.astype("<i4").tobytes()]), pa.array([sizes.astype("<i4").tobytes()]),
        ], fields=list(_BLOCK))
        columns = {"_block": pa.concat_arrays([block, rest])}
        if order:
            columns |= {c: table[c].combine_chunks() for c in order} | dict(zip(("_head", "_tail"), _edge_words(codes, words, sizes, reach)))
        return pa.RecordBatch.from_pydict(columns)

    schema = T.StructType([*(df.schema[c] for c in order or [])])
    for name in ("_head", "_tail") if order else ():
        schema.add(name, T.ArrayType(T.StringType()))
    schema.add("_block", _BLOCK_TYPE)
    names = [f.name for f in schema]
    rows = df.select(*dict.fromkeys([*(order or []), tokens]))
    return rows.mapInArrow(lambda batches: (b.select(names) for b in numbered(batches)), schema)


def _fields(df: DataFrame, tokens: str, *fields: str) -> DataFrame:
    """The column ``tokens``, of blocks just these fields."""
    if not isinstance(df.schema[tokens].dataType, T.StructType):
        return df.select(tokens)
    return df.where(F.col(f"{tokens}.n").isNotNull()).select(F.struct(*(f"{tokens}.{f}" for f in fields)).alias(tokens))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Blocks of whole rows: the number of each token, the words numbered, the row of each token."""

    def block(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        codes, words, sizes = _coded(column, [])
        return codes, words, np.repeat(np.arange(len(sizes)), sizes)

    held, size = [], 0
    for batch in batches:
        column = batch.column(0)
        if pa.types.is_struct(column.type):
            for i in range(len(column)):
                codes, sizes = (np.frombuffer(column.field(f)[i].as_buffer(), "<i4") for f in ("codes", "sizes"))
                words = _read(column.field("words")[i])["word"].combine_chunks()
                yield codes.astype(np.int64), words, np.repeat(np.arange(len(sizes)), sizes)
            continue
        held.append(column)
        size += len(column.flatten())
        if size >= _BLOCK_TOKENS:
            yield block(pa.chunked_array(held).combine_chunks())
            held, size = [], 0
    if held:
        yield block(pa.chunked_array(held).combine_chunks())


def _close_repeats(codes: np.ndarray, row: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a word stands again in its row after fewer than ``reach`` tokens, and where it stood before."""
    order = np.sort((codes << 32) | np.arange(len(codes))) & ((1 << 32) - 1)  # by word, then by place
    before, again = order[:-1], order[1:]
    close = (codes[before] == codes[again]) & (codes[again] >= 0) & (again - before < reach) & (row[before] == row[again])
    return before[close], again[close]


def _more_than_places(codes: np.ndarray, row: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many of the next (of the last) ``reach`` tokens repeat another one of them.

    No word stands there more often than that and once; places of other rows may be counted along.
    """
    before, again = _close_repeats(codes, row, reach)
    n = len(codes)
    following, preceding = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.add.at(following, np.maximum(again - reach, 0), 1)
    np.add.at(following, before, -1)
    np.add.at(preceding, again + 1, 1)
    np.add.at(preceding, np.minimum(before + reach + 1, n), -1)
    return np.cumsum(following[:-1]), np.cumsum(preceding[:-1])


def _word_sums(codes: np.ndarray, sizes: np.ndarray, n_words: int, reach: int) -> list[np.ndarray]:
    """How often each word stands, and how often it may lead and end a pair beyond that."""
    seen, row = codes >= 0, np.repeat(np.arange(len(sizes)), sizes)
    more = (np.bincount(codes[seen], weights=x[seen], minlength=n_words) for x in _more_than_places(codes, row, reach))
    return [np.bincount(codes[seen], minlength=n_words), *(x.astype(np.int64) for x in more)]


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _dealt_words(words: pa.Array, sums: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Words and their numbers, one row for each part they are dealt to by hash."""
    dealt = _hashes(words) % np.uint64(parts)
    order = np.argsort(dealt, kind="stable")
    part, begin = np.unique(dealt[order], return_index=True)
    table = pa.record_batch([x.take(pa.array(order)) for x in (words, *map(pa.array, sums))], ["word", *_SUMS])
    spans = [_written(table.slice(a, b - a)) for a, b in zip(begin, np.r_[begin[1:], len(order)])]
    return pa.record_batch([pa.array(part.astype(np.int32)), pa.array(spans, pa.binary())], ["part", "words"])


def _able_words(
    df: DataFrame, words: DataFrame | None, tokens: str, reach: int, min_freq: int, across: DataFrame | None, parts: int = 16
) -> DataFrame:
    """The words that may begin or end a pair counted ``min_freq`` times.

    A word leads a pair once for each of its places, once more for each repeat behind the place,
    and once for each of its pairs in ``across``; so it is with the pairs it ends. Without ``words``
    the ``frequency`` of every word is counted along.
    """
    counting = words is None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if pa.types.is_struct(column.type):
                found = ((_read(w)["word"].combine_chunks(), _read(x)) for w, x in zip(*map(column.field, ("words", "sums"))))
                sums = ((words, [x.combine_chunks().to_numpy() for x in table.columns]) for words, table in found)
            else:
                codes, words, sizes = _coded(column, [])
                sums = [(words, _word_sums(codes, sizes, len(words), reach))]
            for words, each in sums:
                yield _dealt_words(words, each if counting else [np.zeros_like(each[0]), *each[1:]], parts)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in (0, 1):
                seen = batch.column(at).value_counts()
                seen = seen.filter(seen.field("values").is_valid())
                counts = [np.zeros(len(seen), np.int64)] * 3
                counts[1 + at] = seen.field("counts").to_numpy()
                yield _dealt_words(seen.field("values").cast(pa.string()), counts, parts)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.zeros(len(batch), np.int64)
            yield _dealt_words(batch.column(0).cast(pa.string()), [batch.column(1).to_numpy(), none, none], parts)

    def summed(part: pa.Table) -> pa.Table:
        sums = pa.concat_tables([_read(x) for x in part["words"]]).group_by("word").aggregate([(c, "sum") for c in _SUMS])
        most = pc.add(sums["frequency_sum"], pc.max_element_wise(sums["leads_sum"], sums["ends_sum"]))
        able = sums.filter(pc.greater_equal(most, min_freq))
        return pa.table({"word": able["word"].cast(pa.string()), "frequency": able["frequency_sum"]})

    rows = _fields(df, tokens, "words", "sums").mapInArrow(places, _WORDS_TYPE)
    if across is not None and min_freq > 1:
        rows = rows.unionByName(across.select("word1", "word2").mapInArrow(sides, _WORDS_TYPE))
    if not counting:
        rows = rows.unionByName(words.select("word", "frequency").mapInArrow(known, _WORDS_TYPE))
    return rows.groupBy("part").applyInArrow(summed, "word string, frequency long")


def _word_list(words: DataFrame) -> tuple[pa.Array, np.ndarray, DataFrame | None]:
    """The words down to the lowest frequency at which they fit, their frequencies, and the others if there are any."""
    sizes = words.groupBy("frequency").agg(F.count(F.lit(1)).alias("n")).toArrow()
    frequency, n = sizes["frequency"].to_numpy(), sizes["n"].to_numpy()
    order = np.argsort(-frequency)
    fits = order[np.cumsum(n[order]) <= _LIST_WORDS]
    least = int(frequency[fits].min()) if len(fits) else int(frequency.max(initial=0)) + 1
    held = words.where(F.col("frequency") >= least).select("word", "frequency").toArrow()
    held = held.sort_by([("frequency", "descending"), ("word", "ascending")])
    others = words.where(F.col("frequency") < least) if len(fits) < len(n) else None
    return held["word"].combine_chunks(), held["frequency"].to_numpy(), others


def _marks(words: DataFrame) -> np.ndarray:
    """Bits at the hashes of the words: a word without its bit is none of them."""
    most = _MARKS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_hashes(batch.column(0).cast(pa.string())) % np.uint64(most)).astype(np.int64)
            page, begin = np.unique(at // _PAGE, return_index=True)
            inside = [x.astype("<i4").tobytes() for x in np.split(at % _PAGE, begin[1:])][: len(page)]
            yield pa.record_batch([pa.array(page, pa.int32()), pa.array(inside, pa.binary())], ["page", "bits"])

    def filled(rows: pa.Table) -> pa.Table:
        bits = np.zeros(_PAGE, bool)
        for x in rows["bits"]:
            bits[np.frombuffer(x.as_buffer(), "<i4")] = True
        return pa.table({"page": rows["page"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    typed = "page int, bits binary"
    pages = words.select("word").mapInArrow(places, typed).groupBy("page").applyInArrow(filled, typed).toArrow()
    marks = np.zeros(-(-most // _PAGE) * _PAGE // 8, np.uint8)
    for page, bits in zip(pages["page"].to_pylist(), pages["bits"]):
        marks[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return marks


def _marked(marks: np.ndarray, hashes: np.ndarray, most: int) -> np.ndarray:
    at = (hashes % np.uint64(most)).astype(np.int64)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _borders(frequency: np.ndarray, parts: int) -> np.ndarray:
    """Keys that cut the pairs of the word list into parts of about one size.

    A word leads pairs in proportion to its frequency, and so do its partners; so a frequent
    word's pairs are cut again by their partner.
    """
    ends = np.cumsum(frequency)
    if not len(ends) or parts < 2:
        return np.array([], np.int64)
    total = int(ends[-1])
    at = np.arange(1, parts) * (total / parts)
    first = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
    inside = (at - (ends[first] - frequency[first])) / frequency[first]
    second = np.minimum(np.searchsorted(ends, inside * total, "right"), len(ends) - 1)
    return np.maximum.accumulate((first << _BITS) + second)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed, behind their number and width."""
    most = int(values.max(initial=0))
    width = max(1, -(-most.bit_length() // 8))
    planes = b"".join((values >> (8 * i)).astype(np.uint8).tobytes() for i in range(width))
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    values = planes[0].astype(np.int64)
    for i in range(1, width):
        values |= planes[i].astype(np.int64) << (8 * i)
    return values


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order: the first one, then their differences."""
    return int(keys[0]).to_bytes(8, "little") + _pack(np.diff(keys))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.r_[int.from_bytes(data[:8], "little"), _unpack(data[8:])])


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sum of its counts); sorts the keys in place."""
    if counts is None:
        keys.sort()
    elif int(counts.max(initial=0)) < 1 << (63 - 2 * _BITS) and int(keys.max(initial=0)) < 1 << (2 * _BITS):
        both = (keys << (63 - 2 * _BITS)) | counts  # key and count sort as one number
        both.sort()
        keys, counts = both >> (63 - 2 * _BITS), both & ((1 << (63 - 2 * _BITS)) - 1)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    changes = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=changes[1:-1])
    starts = np.flatnonzero(changes)
    total = np.diff(starts) if counts is None else np.add.reduceat(counts, starts[:-1]) if len(keys) else counts
    return keys[starts[:-1]], total


def _window_counts(
    codes: np.ndarray, row: np.ndarray, start: int, end: int, reach: int, base: int, leads: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``head * base + partner`` of the tokens ``start`` to ``end``, in order, and how often each occurs.

    Codes under 0 are no words, and places without ``leads`` lead no pair. The heads are taken in order, some at a time, so that the keys at
    work stay in the processor's cache; all places of a head are taken at once.
    """
    at = np.flatnonzero(codes[start:end] >= 0 if leads is None else (codes[start:end] >= 0) & leads[start:end]) + start
    both = (codes[at] << 32) | at
    both.sort()
    heads, at = both >> 32, both & ((1 << 32) - 1)
    room = np.cumsum(np.bincount(row))[row[at]] - at if len(at) else at
    short, steps = codes.astype(np.int32), np.arange(1, reach + 1)
    found, begin = [(np.array([], np.int64), np.array([], np.int64))], 0
    while begin < len(at):
        stop = int(np.searchsorted(heads, heads[min(begin + _HEADS, len(at)) - 1], "right"))
        some = slice(begin, stop)
        partner = short.take(at[some, None] + steps, mode="clip")
        keep = (partner >= 0) & (room[some, None] > steps)
        found.append(_summed((heads[some, None] * base + partner)[keep]))
        begin = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def _listed_rows(codes: np.ndarray, row: np.ndarray, start: int, end: int, reach: int, borders: np.ndarray) -> pa.RecordBatch:
    """One row for each part that has pairs of listed words in the stretch."""
    keys, counts = _window_counts(codes, row, start, end, reach, 1 << _BITS)
    cuts = np.r_[0, np.searchsorted(keys, borders), len(keys)]
    parts = np.flatnonzero(np.diff(cuts))
    spans = [slice(cuts[p], cuts[p + 1]) for p in parts]
    columns = {
        "part": pa.array(parts, pa.int32()),
        "pairs": pa.array([_pack_keys(keys[s]) for s in spans], pa.binary()),
        "counts": pa.array([_pack(counts[s]) for s in spans], pa.binary()),
    }
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(parts), f.type) for f in _ROW], schema=_ROW)


def _other_pairs(
    local: np.ndarray, row: np.ndarray, start: int, end: int, reach: int, known: np.ndarray, other: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of listed and ``other`` words, one of them at least not listed: both words, how often.

    Just the places from which such a word can be reached lead pairs.
    """
    base = max(len(known), 1)
    codes = np.r_[np.where(other | (known >= 0), np.arange(len(known)), -1), -1][local]
    met = np.r_[0, np.cumsum(np.r_[other, False][local])]
    leads = met[np.minimum(np.arange(len(local)) + reach + 1, len(local))] > met[:-1]
    keys, counts = _window_counts(codes, row, start, end, reach, base, leads)
    first, second = keys // base, keys % base
    kept = other[first] | other[second]
    return first[kept], second[kept], counts[kept]


def _other_rows(
    first: np.ndarray, second: np.ndarray, counts: np.ndarray, parts: int, words: pa.Array, hashes: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The pairs as lists of words for each part."""
    dealt = ((hashes[first] * np.uint64(31) + hashes[second]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(dealt)
    for at in range(0, len(order), _SLICE_PAIRS):
        some = order[at : at + _SLICE_PAIRS]
        part, begin = np.unique(dealt[some], return_index=True)
        ends = pa.array(np.r_[begin, len(some)], pa.int32())
        columns = {
            "part": pa.array(part, pa.int32()),
            "word1": pa.ListArray.from_arrays(ends, words.take(pa.array(first[some]))),
            "word2": pa.ListArray.from_arrays(ends, words.take(pa.array(second[some]))),
            "n": pa.ListArray.from_arrays(ends, pa.array(counts[some], pa.int64())),
        }
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(part), f.type) for f in _ROW], schema=_ROW)


def count_pairs(
    df: DataFrame, tokens: str, window: int, min_freq: int = 1, across: DataFrame | None = None, counts: bool = False
) -> DataFrame:
    """``(word1, word2, n_pair)`` of every pair counted at least ``min_freq`` times, in order.

    A token is paired with each of the next ``window - 1`` tokens of its row; null tokens take a place
    but make no pair. ``tokens`` are the blocks of ``number_tokens``, read twice. ``across`` are pairs
    ``(word1, word2)`` counted beside them, a row each. With ``counts`` the counts of both words,
    ``n_1`` and ``n_2``, follow.
    """
    spark, reach = df.sparkSession, window - 1
    total = df.agg(F.sum(f"{tokens}.n")).first()[0] or 0
    least = 2 * spark.sparkContext.defaultParallelism
    words = materialize(_able_words(df, None, tokens, reach, min_freq, across, max(least, -(-total // _PART_WORDS))))
    listed, frequency, others = _word_list(words)
    rare, most = others is not None, _MARKS
    parts = max(least, -(-total * reach // _PART_PAIRS))
    shared = spark.sparkContext.broadcast((listed, frequency, _borders(frequency, parts), _marks(others) if rare else None))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, borders, marks = shared.value
        for local, own, row in _blocks(batches):
            known = pc.fill_null(pc.index_in(own, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = np.r_[known, -1][local]  # the last entry stands for null tokens
            if rare:
                hashes = _hashes(own)
                other = (known < 0) & _marked(marks, hashes, most)
            for start in range(0, len(local), _BLOCK_TOKENS):
                end = min(start + _BLOCK_TOKENS, len(local))
                yield _listed_rows(codes, row, start, end, reach, borders)
                if rare:
                    yield from _other_rows(*_other_pairs(local, row, start, end, reach, known, other), parts, own, hashes)

    def summed(part: pa.Table) -> pa.Table:
        names, often, *_ = shared.value
        packed = [(p, c) for p, c in zip(part["pairs"].to_pylist(), part["counts"].to_pylist()) if p is not None]
        tables = []
        if packed:
            keys, n = _summed(
                np.concatenate([_unpack_keys(p) for p, _ in packed]), np.concatenate([_unpack(c) for _, c in packed])
            )
            keys, n = keys[n >= min_freq], n[n >= min_freq]
            first, second = keys >> _BITS, keys & ((1 << _BITS) - 1)
            tables.append(pa.table([names.take(pa.array(first)), names.take(pa.array(second)), n, often[first], often[second]], schema=kept))
        unlisted = pa.table({
            "word1": pc.list_flatten(part["word1"]), "word2": pc.list_flatten(part["word2"]), "n": pc.list_flatten(part["n"]),
        })
        if len(unlisted):
            sums = unlisted.group_by(["word1", "word2"]).aggregate([("n", "sum")]).filter(pc.field("n_sum") >= min_freq)
            unknown = pa.nulls(len(sums), pa.int64())
            tables.append(pa.table([sums["word1"], sums["word2"], sums["n_sum"], unknown, unknown], schema=kept))
        return pa.concat_tables(tables) if tables else kept.empty_table()

    kept = pa.schema([("word1", pa.string()), ("word2", pa.string()), *((n, pa.int64()) for n in ("n_pair", "n_1", "n_2"))])
    rows = _fields(df, tokens, "words", "codes", "sizes").mapInArrow(counted, _ROW_TYPE)
    if across is not None:
        rows = rows.unionByName(across.select(F.array("word1", "word2")).mapInArrow(counted, _ROW_TYPE))
    pairs = rows.groupBy("part").applyInArrow(summed, "word1 string, word2 string, n_pair long, n_1 long, n_2 long")
    if not counts:
        return pairs.drop("n_1", "n_2")
    if not rare:
        return pairs
    pairs = materialize(pairs)  # pairs with a word that is not listed get the counts by joins
    first = words.select(F.col("word").alias("word1"), F.col("frequency").alias("n_1"))
    second = words.select(F.col("word").alias("word2"), F.col("frequency").alias("n_2"))
    scored = pairs.where(F.col("n_1").isNull()).drop("n_1", "n_2").join(first, "word1").join(second, "word2")
    return pairs.where(F.col("n_1").isNotNull()).unionByName(scored)
