"""Near-duplicate classes by a grouped prefix join on word-shingle sets.

Two sets of Jaccard similarity t or more share a token of their prefixes (the first
``n - ceil(t n) + 1`` tokens in one fixed order), whatever the order. Documents with the same
prefix and size form one group, and only groups meet: one posting a group and token. Documents
with equal sets are one class, so copies cost nothing beyond their membership row.

Not every pair has to be verified to know the classes. First each group of a posting list
meets one pivot of about its size; what links is contracted to components, and what is still
apart meets other pivots. Then all pairs left, whose members are still in different components,
are verified too. Nothing is capped: a hot list of near copies collapses in the first steps,
and the order puts shingles that many documents share behind all others, so that shared
passages hardly ever stand in a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected
from corpusloom.llm.packed_text import mix
from corpusloom.llm.shingle_sets import distinct_sets, ordered_shingles
from corpusloom.runtime import materialize, materialize_counted

SHINGLE, PERCENT = 5, 80

#: Knowledge about frequent shingles; it shapes the order, never the result. Counted are shingles
#: that recur inside a run of ``CHUNK`` shingles, all those whose hash ends in ``SEED_BITS``
#: zeros (a passage holds some), and those within ``REACH`` words of either. The ``FREQUENT``
#: most frequent of at least ``LEAST`` are known to all tasks (16 bytes each).
CHUNK, LEAST, FREQUENT, SEED_BITS, REACH = 1_000_000, 8, 1 << 18, 3, 48
#: Rounds of one pivot a list before all pairs left are looked at.
ROUNDS = 2
#: Classes that are sent to the pass that writes their sets (16 bytes each); more are joined by shuffle.
SENT_CLASSES = 1 << 20
#: Sizes of a band of the last step.
_RATIO = 1.12

_U = np.uint64


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text), F.lit("")).alias("text"))


def _counted(found: Iterator[np.ndarray], kept) -> Iterator[pa.RecordBatch]:
    """token and n over runs of about CHUNK shingles, for the tokens that ``kept`` names."""
    held, n = [], 0

    def count() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        wanted = kept(h, c)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[wanted].view(np.int64)), pa.array(c[wanted].astype(np.int64))], ["token", "n"]
        )

    for h in found:
        held.append(h)
        n += len(h)
        if n >= CHUNK:
            yield count()
            held, n = [], 0
    if n:
        yield count()


def _most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent tokens, at most FREQUENT."""
    found = (
        counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        .orderBy(F.desc("n"), "token").limit(FREQUENT)
    ).toArrow()
    token = np.asarray(found["token"]).astype(np.int64).view(_U)
    order = np.argsort(token)
    return token[order], np.asarray(found["n"]).astype(np.int64)[order]


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def frequent_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles seen in many documents."""
    seed = _U((1 << SEED_BITS) - 1)

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (h for b in batches for _, h, _ in distinct_sets(b.column(0), size))
        yield from _counted(sets, lambda h, c: (c > 1) | (h & seed == 0))

    first = _most_frequent(_texts(docs, text).mapInArrow(recurring, "token bigint, n bigint"))
    shared = docs.sparkSession.sparkContext.broadcast(first[0])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def neighbours() -> Iterator[np.ndarray]:
            for b in batches:
                for _, h, of in ordered_shingles(b.column(0), size):
                    hit = _among(h, shared.value)
                    at = np.flatnonzero(hit)
                    steps = np.zeros(len(h) + 1, np.int64)
                    np.add.at(steps, np.maximum(at - REACH, np.searchsorted(of, of[at])), 1)
                    np.add.at(steps, np.minimum(at + REACH + 1, np.searchsorted(of, of[at], "right")), -1)
                    yield h[(np.cumsum(steps[:-1]) > 0) & ~hit]

        yield from _counted(neighbours(), lambda h, c: c > 0)

    second = _most_frequent(_texts(docs, text).mapInArrow(around, "token bigint, n bigint"))
    token, count = (np.concatenate(x) for x in zip(first, second, strict=True))
    best = np.lexsort((token, -count))[:FREQUENT]
    order = best[np.argsort(token[best])]
    return token[order], count[order]


def _prefix(tokens: np.ndarray, known: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """First tokens of one sorted set in the common order: unknown ones by hash, then by count."""
    n = len(tokens)
    length = n - (percent * n + 99) // 100 + 1
    hashes, counts = known
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
        often = np.where(hashes[at] == tokens, counts[at], 0)
        if often.any():
            return tokens[np.lexsort((tokens, often))[:length]]
    return tokens[:length]


def _ids(tokens: np.ndarray, n: int) -> int:
    """One 64-bit number for a set of tokens and a size."""
    return int(mix(np.add.reduce(mix(tokens ^ _U(0x5851F42D4C957F2D))).reshape(1) + _U(n)).view(np.int64)[0])


def _sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of ``n`` to ``2 n`` even ranges of hashes, a byte each.

    Empty, which filters nothing, if a range holds too many.
    """
    bits = len(tokens).bit_length()
    counts = np.bincount((tokens >> _U(1) >> _U(63 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether the sketches allow the similarity; never false for a pair that has it."""
    if not x or not y:
        return True
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (x, y))
    size = min(len(a), len(b))
    a, b = a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)
    most = int(np.minimum(a, b).sum())
    return 100 * most >= percent * (n + m - most)


def _described(docs: DataFrame, key: str, text: str, size: int, percent: int, shared) -> DataFrame:
    """One row per document: doc_id, n, node (its set), grp (prefix and size), sketch, prefix.

    Sketch and prefix come once for each set and group in a task; copies have nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: set[int] = set()
        groups: set[int] = set()
        for b in batches:
            for first, h, cuts in distinct_sets(b.column(1), size):
                node, grp, sketch, prefix = [], [], [], []
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    tokens = h[a:z]
                    node.append(_ids(tokens, z - a) if z > a else None)
                    lead = _prefix(tokens, shared.value, percent) if z > a else None
                    grp.append(_ids(lead, z - a) if z > a else None)
                    new_set, new_group = z > a and node[-1] not in sets, z > a and grp[-1] not in groups
                    sketch.append(_sketch(tokens) if new_set else None)
                    prefix.append(lead.view(np.int64) if new_group else None)
                    if z > a:
                        sets.add(node[-1])
                        groups.add(grp[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(cuts) - 1),
                        pa.array(np.diff(cuts).astype(np.int64)),
                        pa.array(node, pa.int64()),
                        pa.array(grp, pa.int64()),
                        pa.array(sketch, pa.binary()),
                        pa.array(prefix, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "node", "grp", "sketch", "prefix"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, text, F.col(key).alias("doc_id")).mapInArrow(
        run, f"doc_id {kind}, n bigint, node bigint, grp bigint, sketch binary, prefix array<bigint>"
    )


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes of one band differ by less than a quarter."""
    return np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of (token, n, grp) that share their token, with the first of the band.

    Only the last row and the current pivot are carried from batch to batch.
    """
    names = ["token", "n", "grp", "place", "pivot", "pivot_n"]
    held = None  # last row: token, n, grp, place, pivot, pivot_n, whether an earlier row has its token

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [np.int64, np.int32, np.int64, np.int32, np.int64, np.int32]
        return pa.RecordBatch.from_arrays([pa.array(r.astype(k)) for r, k in zip(rows, kinds, strict=True)], names)

    for b in batches:
        token, n, grp, place = (np.asarray(b.column(i)).astype(np.int64) for i in range(4))
        if held is not None:
            token, n, grp, place = (np.concatenate([[x], y]) for x, y in zip(held[:4], (token, n, grp, place), strict=True))
        new = np.ones(len(token), bool)  # the same group comes once from each task
        new[1:] = (token[1:] != token[:-1]) | (grp[1:] != grp[:-1]) | (n[1:] != n[:-1])
        token, n, grp, place = token[new], n[new], grp[new], place[new]
        if not len(token):
            continue
        band = _band(n)
        start = np.ones(len(token), bool)
        start[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
        first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
        pivot, pivot_n = grp[first], n[first]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        if held is not None:
            of_held = first == 0
            pivot, pivot_n = np.where(of_held, held[4], pivot), np.where(of_held, held[5], pivot_n)
            same[0] = held[6]
        out = (same[:-1] | same[1:])[:-1]
        if out.any():
            yield emit([x[:-1][out] for x in (token, n, grp, place, pivot, pivot_n)])
        held = (token[-1], n[-1], grp[-1], place[-1], pivot[-1], pivot_n[-1], bool(same[-2]))
    if held is not None and held[6]:
        yield emit([np.array([x]) for x in held[:6]])


def _alike(n: str, m: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, m, x, y = (rows.column(i).to_pylist() for i in range(2, 6))
            kept = [_may_link(p, q, k, l, percent) for p, q, k, l in zip(x, y, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays(rows.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """node and tokens of the classes ``wanted(node, least_id)``, from the row that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, cuts in distinct_sets(b.column(1), size):
                own = [_ids(h[a:z], z - a) if z > a else None for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                tokens = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h.view(np.int64)))
                ids = b.column(0).slice(first, len(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int64()), tokens], ["id", "node", "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    found = _texts(docs, text, F.col(key).alias("id")).mapInArrow(run, f"id {kind}, node bigint, tokens array<bigint>")
    wanted, n_wanted = materialize_counted(wanted.select("node", "least_id"))
    few = F.broadcast(wanted) if n_wanted <= SENT_CLASSES else wanted
    stood = found.join(few, "node").where(F.col("id").eqNullSafe(F.col("least_id"))).select("node", "tokens")
    sets, n = materialize_counted(stood)
    # more rows than classes: an id stands on several rows
    return sets if n == n_wanted else materialize(sets.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, classes: DataFrame) -> DataFrame:
    """u, v: the pairs (a, b) that reach the similarity."""
    pairs, count = materialize_counted(_possible(pairs, classes, percent))
    if not count:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")).join(pairs, "b")
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")).join(pairs.select("a"), "a", "left_semi")
    common = F.size(F.array_intersect("x", "y"))
    return (
        second.join(first, "a")
        .where(100 * common >= percent * (F.size("x") + F.size("y") - common))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Common tokens that sets of two sizes need: ceil(p (n + m) / (100 + p))."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _facing(postings: DataFrame, percent: int) -> DataFrame:
    """Add ``low`` and ``high`` (bands of the two sizes) for every band that can still link there.

    The first common token of a linking pair stands no farther back, in either set, than leaves
    room for the overlap that their sizes need. A token farther back than that for the smallest
    size of a band is not shown to that band.
    """
    here = F.col("band")
    edge = F.ceil(F.pow(F.lit(_RATIO), F.col("other") - 1e-9) - 1e-6).cast("long")
    smallest = F.greatest(edge, F.ceil(F.col("n") * percent / 100).cast("long"))
    room = F.col("n") - _least_overlap(F.col("n"), smallest, percent) + 1
    reach = F.ceil(F.log(F.lit(100.0 / percent)) / F.log(F.lit(_RATIO)) + 1).cast("int")
    return (
        postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(_RATIO)) + 1e-9).cast("int"))
        .withColumn("other", F.explode(F.sequence(here - reach, here + reach)))
        .where((100 * F.col("n") >= percent * edge) & (F.col("place") <= room))
        .withColumns({"low": F.least(here, "other"), "high": F.greatest(here, "other"), "lower": here <= F.col("other")})
    )


def near_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id reachable by links (null ids do not count, but rows
    without id link like others; they have a null component only if all of it lacks ids). Null,
    empty and wordless texts have no shingles and stand alone. Repeated rows are one class. An
    empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, size))
    described = materialize(_described(docs, key, text, size, percent, shared))
    members = described.select("doc_id", "n", "node")
    classes = materialize(
        described.where(F.col("n") > 0).groupBy("node", "n", "grp")
        .agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"), F.max("sketch").alias("sketch"))
    )
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = described.where(F.col("prefix").isNotNull()).select(
        F.posexplode("prefix").alias("place", "token"), F.col("n").cast("int").alias("n"), "grp"
    ).select("token", "n", "grp", (F.col("place") + 1).alias("place"))
    met = materialize(
        postings.repartition(partitions, "token").sortWithinPartitions("token", "n", "grp")
        .mapInArrow(_meetings, "token bigint, n int, grp bigint, place int, pivot bigint, pivot_n int")
    )
    inside = classes.groupBy("grp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("k"))
    crowded = inside.where(F.col("k") > 1)

    # one pivot for each list and band, and one for each group of several classes
    group_pairs = (
        met.where((F.col("grp") != F.col("pivot")) & _alike("n", "pivot_n", percent))
        .select("pivot", "grp").distinct()
    )
    of_pivot = inside.select(F.col("grp").alias("pivot"), F.col("first").alias("a"))
    of_group = classes.select("grp", F.col("node").alias("b"))
    pairs = group_pairs.join(of_pivot, "pivot").join(of_group, "grp").select("a", "b")
    own = classes.join(crowded, "grp").where(F.col("node") != F.col("first"))
    pairs = pairs.union(own.select(F.col("first").alias("a"), F.col("node").alias("b")))
    pairs = materialize(pairs.distinct())
    tried = _undirected(pairs)

    # what shares a token; members of one group share the first of their prefix
    placed = met.select("token", "grp", "place").union(crowded.select(F.col("grp").alias("token"), "grp", F.lit(1).alias("place")))
    placed = placed.join(classes.select("grp", "node", "n"), "grp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    placed = materialize(placed.select("token", "node", "n", "place", band.alias("band")))
    sets = _sets_of(docs, key, text, size, classes.join(placed.select("node").distinct(), "node", "left_semi"))
    links = materialize(_verified(pairs, sets, percent, classes))
    roots = materialize(connected(links))

    def still_apart() -> DataFrame:
        rooted = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lists = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        return rooted.join(lists.where(F.col("lo") != F.col("hi")).select("token"), "token", "left_semi")

    for k in range(1, ROUNDS + 1):
        # another pivot for each list: what missed one member of a component may meet another
        apart = still_apart()
        pivot = apart.groupBy("token", "band").agg(
            F.min_by(F.struct("node", "n", "root"), F.xxhash64("token", "node", F.lit(k))).alias("p")
        )
        pairs = apart.join(pivot, ["token", "band"]).select("token", "band", "node", "n", "root", "p.node", F.col("p.n").alias("pn"), F.col("p.root").alias("proot"))
        pairs = pairs.toDF("token", "band", "b", "n", "root", "a", "pn", "proot")
        pairs = pairs.where((F.col("root") != F.col("proot")) & _alike("n", "pn", percent)).select("a", "b").distinct()
        pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(
            tried.toDF("lo", "hi"), ["lo", "hi"], "left_anti"
        )
        pairs, n = materialize_counted(pairs.select("a", "b"))
        if not n:
            break
        tried = tried.union(_undirected(pairs))
        more, n = materialize_counted(_verified(pairs, sets, percent, classes))
        if not n:
            break
        links = links.union(more)
        roots = materialize(connected(links))

    facing = materialize(_facing(still_apart().drop("band"), percent).select("token", "low", "high", "lower", "node", "n", "place", "root"))
    left = facing.where("lower").select("token", "low", "high", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("root").alias("xr"))
    right = facing.where(~F.col("lower") | (F.col("low") == F.col("high"))).select(
        "token", "low", "high", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yp"), F.col("root").alias("yr")
    )
    need = _least_overlap(F.col("xn"), F.col("yn"), percent)
    rest = (
        left.join(right, ["token", "low", "high"])
        .where(
            (F.col("xr") != F.col("yr")) & _alike("xn", "yn", percent)
            & (F.col("xp") <= F.col("xn") - need + 1) & (F.col("yp") <= F.col("yn") - need + 1)
            & ((F.col("low") < F.col("high")) | (F.col("x") < F.col("y")))
        )
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    rest, n = materialize_counted(rest.join(tried, ["a", "b"], "left_anti"))
    if n:
        links = links.union(_verified(rest, sets, percent, classes))
        roots = materialize(connected(links))

    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(
        F.min("least_id").alias("component_id"), F.sum("rows").alias("all_rows")
    )
    named = rooted.join(least.where(F.col("all_rows") > 1), "root").select("node", "component_id", F.lit(True).alias("linked"))
    return members.join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
