"""Operators on embedding tables: centrality, projection, encoders and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine, dot, doubles, unit
from corpusloom.operators.ordering import with_running_total
from corpusloom.runtime import materialize

Encoder = Callable[[Column], Column] | Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


# --- centrality ----------------------------------------------------------------------


def mean_similarity(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Add ``avg_similarity``: mean cosine to all rows of the group, the row itself included.

    The mean of the cosines is the inner product with the summed unit vectors, so the n x n
    matrix is never built; the sum is a map-side combined vector aggregate.
    """
    units = df.withColumn("_unit", unit(F.col(vec)))
    sums = units.groupBy(group).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_unit")))).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
    )
    return (
        units.join(sums, group)
        .withColumn("avg_similarity", dot(F.col("_unit"), F.col("_sum")) / F.col("_n"))
        .drop("_unit", "_sum", "_n")
    )


def central_extremes(df: DataFrame, group: str, id_col: str, vec: str = "embedding") -> DataFrame:
    """Most and least central row of every group; ties go to the smaller id."""
    scored = mean_similarity(df, group, vec).withColumn("_s", F.round("avg_similarity", 6))
    best = F.max(F.struct("_s", (-F.col(id_col)).alias("_i")))
    worst = F.min(F.struct("_s", F.col(id_col).alias("_i")))
    return (
        scored.groupBy(group)
        .agg(best.alias("_b"), worst.alias("_w"))
        .select(
            group,
            (-F.col("_b._i")).alias("most_similar_id"),
            F.col("_b._s").alias("most_similar_score"),
            F.col("_w._i").alias("least_similar_id"),
            F.col("_w._s").alias("least_similar_score"),
        )
    )


def group_centroids(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean unit vector of every group as ``(group, embedding)``."""
    return df.groupBy(group).agg(
        vector_to_array(Summarizer.mean(array_to_vector(unit(F.col(vec))))).alias("embedding")
    )


# --- projection ----------------------------------------------------------------------


def pca_project(
    df: DataFrame, k: int, vec: str = "embedding", group: str | None = None, name: str = "coords",
    only_above: int = 0,
) -> DataFrame:
    """Project onto the first ``k`` principal components, fitted per group or on all rows.

    Vectors of at most ``only_above`` entries are taken as they are.

    First and second moments are summed per Arrow batch, then by a combining aggregate; only
    a d x d matrix per group is decomposed. The largest entry of a component is positive.
    """
    if only_above:
        widest = df.agg(F.max(F.size(vec))).first()[0] or 0
        if widest <= only_above:
            return df.withColumn(name, doubles(F.col(vec)))
    key = F.col(group).cast("string") if group else F.lit("")
    rows = df.withColumn("_key", key).withColumn("_vec", doubles(F.col(vec)))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, part in batch.groupby("_key", sort=False):
                x = np.vstack(part["_vec"])
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                out.append({"_key": value, "_m": flat})
            yield pd.DataFrame(out)

    @F.pandas_udf("struct<mean: array<double>, axes: array<array<double>>>")
    def axes_of(sums: pd.Series) -> pd.DataFrame:
        means, axes = [], []
        for flat in sums:
            d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
            n, mean = flat[0], flat[1 : d + 1] / flat[0]
            spread = np.reshape(flat[d + 1 :], (d, d)) / n - np.outer(mean, mean)
            values, vectors = np.linalg.eigh(spread)
            top = vectors[:, np.argsort(-values)[:k]].T
            lead = np.abs(top).argmax(1)
            top = top * np.sign(top[np.arange(len(top)), lead])[:, None]
            means.append(mean)
            axes.append(top.tolist())
        return pd.DataFrame({"mean": means, "axes": axes})

    fitted = (
        rows.select("_key", "_vec")
        .mapInPandas(moments, "_key string, _m array<double>")
        .groupBy("_key")
        .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_m")))).alias("_m"))
        .select("_key", axes_of("_m").alias("_basis"))
    )
    centred = F.zip_with("_vec", F.col("_basis.mean"), lambda x, m: x - m)
    return (
        rows.join(fitted, "_key")
        .withColumn("_vec", centred)
        .withColumn(name, F.transform(F.col("_basis.axes"), lambda axis: dot(axis, F.col("_vec"))))
        .drop("_key", "_vec", "_basis")
    )


# --- encoders ------------------------------------------------------------------------


@dataclass(frozen=True)
class WordVectors:
    """A trained model of the frequent words, also sent to every task, and a table ``(word, vector)`` of all others."""

    model: PipelineModel
    known: Broadcast
    rare: DataFrame
    tokens: str


def fit_word2vec(
    df: DataFrame, tokens: str = "tokens", size: int = 64, seed: int = 42, max_trained: int = 100_000, **params
) -> PipelineModel | WordVectors:
    """Train word vectors on the token column; a text is the mean of its words.

    Trained in as many partitions as the session shuffles into. The trainer keeps its vocabulary on
    the driver and sends it to every task, so beyond ``max_trained`` words it trains the frequent
    ones. Each other word starts at a small vector of its own and is moved by the mean of the
    trained words around its occurrences.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    params = {"minCount": 1, "numPartitions": parts, **params}
    words = materialize(
        df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= params["minCount"])
    )
    least = _least_count(words, max_trained, params["minCount"])
    stage = Word2Vec(
        vectorSize=size, inputCol=tokens, outputCol="_encoded", seed=seed, **(params | {"minCount": least})
    )
    model = Pipeline(stages=[stage]).fit(df)
    if least == params["minCount"]:
        return model
    known = df.sparkSession.sparkContext.broadcast(_vectors_of(model))
    met = df.select(F.col(tokens).alias("_t")).mapInArrow(
        _surroundings(known, stage.getWindowSize()), "word string, n long, " + ", ".join(f"v{i} double" for i in range(size))
    )
    if params["minCount"] > 1:
        met = met.join(words.select("word"), "word", "left_semi")
    return WordVectors(model, known, materialize(_rare_vectors(met, size)), tokens)


def _vectors_of(model: PipelineModel) -> tuple[pa.Array, np.ndarray]:
    """The words of a model and their vectors; a last vector, for all other words, is zero."""
    held = model.stages[0].getVectors().select("word", vector_to_array("vector", "float32").alias("v")).toArrow().combine_chunks()
    vectors = held["v"].combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1)
    return held["word"].combine_chunks(), np.vstack([vectors, np.zeros_like(vectors[:1])])


def _places(lists: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of the lists, the number of each, ``len(words)`` for one that is not in ``words``, and where the lists end."""
    flat = lists.flatten()
    number = pc.fill_null(pc.index_in(flat, value_set=words), len(words)).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return flat, number, np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _surroundings(known: Broadcast, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token lists to ``(word, n, v0, ...)``: words not in the model, how often they are met, and the sum of the mean
    vectors around their places. Words without a vector, the word itself among them, give no weight to a mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = known.value
        for batch in batches:
            flat, number, ends = _places(batch.column(0), words)
            others = np.flatnonzero(number == len(words))
            for at in np.split(others, range(_PLACES, len(others), _PLACES)):
                text = np.searchsorted(ends, at, "right")
                low, high = np.maximum(at - reach, ends[text - 1]), np.minimum(at + reach + 1, ends[text])
                total = np.zeros((len(at), vectors.shape[1]))
                for k in range(2 * reach + 1):
                    here = low + k
                    total += vectors[np.where(here < high, number[np.minimum(here, high - 1)], len(words))]
                total /= (high - low)[:, None]
                coded = flat.take(pa.array(at)).dictionary_encode()
                codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0][: len(order)])
                named = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).take(pa.array(codes[order][first]))
                sums = np.add.reduceat(total[order], first, axis=0) if len(first) else total
                columns = [named, pa.array(np.diff(np.r_[first, len(order)])), *map(pa.array, np.ascontiguousarray(sums.T))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", *[f"v{i}" for i in range(len(columns) - 2)]])

    return run


_PLACES = 1 << 16  # places whose vectors are held at a time


def _least_count(words: DataFrame, most: int, least: int) -> int:
    """The lowest count, ``least`` or more, down to which at most ``most`` words are met; the highest one always counts."""
    sizes = sorted(((r.n, r["count"]) for r in words.groupBy("n").count().collect()), reverse=True)
    met = 0
    for n, (count, held) in enumerate(sizes):
        met += held
        if n and met > most:
            return sizes[n - 1][0]
    return least


def _rare_vectors(met: DataFrame, size: int) -> DataFrame:
    """``(word, vector)`` of the words the trainer left out: a start by hash moved by the mean of their surroundings."""
    moved = met.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(size)])
    draw = lambda i: ((F.xxhash64("word", F.lit(i)) % 1_000_003) / 1_000_003 / 2 / size)
    return moved.select("word", F.array(*[F.col(f"v{i}") / F.col("n") + draw(i) for i in range(size)]).alias("vector"))


def fit_tfidf(df: DataFrame, tokens: str = "tokens", size: int = 4096) -> PipelineModel:
    """Hashed term frequencies weighted by inverse document frequency."""
    counts = HashingTF(numFeatures=size, inputCol=tokens, outputCol="_counts")
    weight = IDF(inputCol="_counts", outputCol="_encoded")
    return Pipeline(stages=[counts, weight]).fit(df)


def embed_with_model(df: DataFrame, model: PipelineModel | WordVectors, name: str = "embedding") -> DataFrame:
    """Encode with a fitted model; vectors come out as ``array<float>``."""
    if isinstance(model, WordVectors):
        return _embed_all_words(df, model, name)
    encoded = model.transform(df)
    extra = [c for c in encoded.columns if c.startswith("_")]
    return encoded.withColumn(name, vector_to_array("_encoded", "float32")).drop(*extra)


def _embed_all_words(df: DataFrame, vectors: WordVectors, name: str) -> DataFrame:
    """The mean over the trained words plus the share of the other ones, joined by word."""
    size = vectors.known.value[1].shape[1]
    met = F.arrow_udf(_trained_sums(vectors.known), "struct<total: array<double>, others: array<string>>")
    rows = materialize(
        df.withColumns({"_row": F.monotonically_increasing_id(), "_n": F.size(vectors.tokens), "_met": met(vectors.tokens)})
    )
    others = (
        rows.select("_row", F.explode("_met.others").alias("word"))
        .join(vectors.rare, "word")
        .groupBy("_row")
        .agg(*[F.sum(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(size)])
        .select("_row", F.array(*[f"v{i}" for i in range(size)]).alias("_others"))
    )
    total = F.coalesce(F.zip_with("_met.total", "_others", lambda x, y: x + y), F.col("_met.total"))
    mean = F.transform(total, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0).cast("float"))
    return rows.join(others, "_row", "left").withColumn(name, mean).select(*df.columns, name)


def _trained_sums(known: Broadcast) -> Callable[[pa.Array], pa.Array]:
    """Token lists to the sum of the vectors of their trained words, and a list of the other words."""

    def run(lists: pa.Array) -> pa.Array:
        words, vectors = known.value
        flat, number, ends = _places(lists, words)
        totals = np.zeros((len(lists), vectors.shape[1]))
        for low in range(0, len(number), _PLACES):
            high = min(low + _PLACES, len(number))
            first, last = np.searchsorted(ends, [low, high - 1], "right") - 1
            cuts = np.clip(ends[first : last + 1], low, high) - low
            held = np.flatnonzero(np.diff(np.r_[cuts, high - low]))  # texts without tokens have no sum
            totals[first + held] += np.add.reduceat(vectors[number[low:high]].astype(np.float64), cuts[held], axis=0)
        other = number == len(words)
        many = np.r_[0, np.cumsum(other)][ends]
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(totals.ravel()))
        rest = pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), flat.filter(pa.array(other)))
        return pa.StructArray.from_arrays([sums, rest], ["total", "others"])

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return run


def embed_text(
    df: DataFrame,
    text: str,
    encoder: Encoder | None = None,
    name: str = "embedding",
    native: bool = False,
    fallback: PipelineModel | WordVectors | None = None,
    tokens: str = "tokens",
) -> DataFrame:
    """Add an embedding column.

    ``encoder`` turns an iterator of text batches into an iterator of vector batches and runs
    as an Arrow batch function (load the model once before the loop). With ``native`` it is a
    column expression instead. Without an encoder the ``fallback`` model is used, or word
    vectors trained on the table itself.
    """
    if encoder is None:
        return embed_with_model(df, fallback or fit_word2vec(df, tokens), name)
    if native:
        return df.withColumn(name, encoder(F.col(text)))
    batched = F.pandas_udf(_with_hints(encoder), "array<float>")
    return df.withColumn(name, batched(F.coalesce(F.col(text), F.lit(""))))


def _with_hints(encoder):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encoder(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def letter_profile(text: Column) -> Column:
    """A tiny native encoder: how often each letter a-z occurs, as ``array<float>``."""
    return F.arrow_udf(_letter_counts, "array<float>")(F.lower(text))


_LETTERS = 26
_LETTER_OF = np.full(256, _LETTERS, np.uint8)
_LETTER_OF[ord("a") : ord("z") + 1] = np.arange(_LETTERS)
_LETTER_BYTES = 1 << 20  # bytes counted at a time


def _letter_counts(texts: pa.Array) -> pa.Array:
    """Letters of lower-cased texts, counted as bytes; a null text has null counts."""
    held = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    counts = np.zeros((len(held), _LETTERS + 1), np.int64)
    for low in range(ends[0], ends[-1], _LETTER_BYTES):
        high = min(low + _LETTER_BYTES, ends[-1])
        first, last = np.searchsorted(ends, [low, high - 1], "right") - 1
        held_here = np.diff(np.clip(ends[first : last + 2], low, high))
        rows = np.repeat(np.arange(len(held_here)) * (_LETTERS + 1), held_here)
        letters = _LETTER_OF[np.frombuffer(held.buffers()[2], np.uint8, high - low, low)]
        counts[first : last + 1] += np.bincount(rows + letters, minlength=len(held_here) * (_LETTERS + 1)).reshape(-1, _LETTERS + 1)
    flat = counts[:, :_LETTERS].astype(np.float32).ravel()
    gone = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), _LETTERS)
    places = pa.array(np.arange(len(held) + 1, dtype=np.int32) * _LETTERS)
    return pa.ListArray.from_arrays(places, pa.array(flat, mask=gone))


# --- evaluation ----------------------------------------------------------------------


def average_ranks(df: DataFrame, value: str, name: str, times: str | None = None) -> DataFrame:
    """``(value, rank)`` with ties sharing the mean of their ranks; a row counts ``times`` times."""
    counts = df.groupBy(value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
    running = with_running_total(counts, [value], "_n", "_before")
    return running.select(value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def evaluate_encoder(
    pairs: DataFrame, vec_a: str = "vec_a", vec_b: str = "vec_b", label: str = "label"
) -> DataFrame:
    """One row ``(n_pairs, pearson, spearman)`` of cosine against label.

    Pairs are counted by (cosine, label) as they are scored; ranks and sums come from the counts.
    """
    scored = materialize(
        pairs.select(
            F.round(cosine(F.col(vec_a), F.col(vec_b)), 6).alias("_cos"), F.col(label).alias("_label")
        )
        .groupBy("_cos", "_label")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    ranked = materialize(
        scored.join(average_ranks(scored, "_cos", "_rc", "_times"), "_cos").join(
            average_ranks(scored, "_label", "_rl", "_times"), "_label"
        )
    )
    return _correlations(ranked, {"pearson": ("_cos", "_label"), "spearman": ("_rc", "_rl")}, "_times")


def _correlations(df: DataFrame, asked: dict[str, tuple[str, str]], times: str) -> DataFrame:
    """``(n_pairs, ...)``: the number of rows and correlations of columns, a row counting ``times`` times.

    Columns are centred before they are squared; one row, or columns that do not vary, have none.
    """
    names = [c for pair in asked.values() for c in pair]
    total = lambda x: F.sum(F.col(times) * x)
    sums = df.agg(F.sum(times).alias("_n"), *[total(F.col(c).cast("double")).alias(f"_sum{c}") for c in names])
    off = lambda c: F.col(c) - F.col(f"_sum{c}") / F.col("_n")
    moments = (
        df.crossJoin(F.broadcast(sums))
        .agg(
            F.coalesce(F.sum(times), F.lit(0)).alias("n_pairs"),
            *[total(off(x) * off(y)).alias(f"_{name}") for name, (x, y) in asked.items()],
            *[F.when(F.min(c) < F.max(c), total(off(c) * off(c))).otherwise(0.0).alias(f"_square{c}") for c in names],
        )
    )
    spread = lambda x, y: F.sqrt(F.col(f"_square{x}") * F.col(f"_square{y}"))
    return moments.select(
        "n_pairs", *[F.when(F.col("n_pairs") > 1, F.col(f"_{name}") / spread(x, y)).alias(name) for name, (x, y) in asked.items()]
    )
