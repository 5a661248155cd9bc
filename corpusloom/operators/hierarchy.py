"""Hierarchical clustering of a sparse distance table, and the cuts of the tree.

Average, complete and single linkage never bring a third cluster closer to two that merge, so all
closest reciprocal pairs merge in one round. A pair of clusters keeps one number for its listed
distances (their sum, largest or smallest) and how many are listed; every unlisted word pair is at
the constant ``absent``. Single linkage needs the lightest edges only: a spanning forest is grown
first, each component taking its lightest way out, and the tree is read off the forest.

A cluster is named by its smallest word, so every word disappears into a smaller one at most
once. Those disappearances form the forest that all cuts work on.

Ties go to the pair with the smaller names. At ``absent``, where most pairs are tied, this rule
makes the smallest cluster that has a partner there take up, in order of name, every cluster that
is not farther from what it holds. That is the first independent set, by name, of the graph of
farther pairs, so it is merged in one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import with_row_ids, with_running_total
from corpusloom.runtime import materialize, materialize_counted

_EPSILON = 1e-12  # distances closer than this are ties
_PAIR = ["a", "b", "na", "nb", "ha", "hb", "ra", "rb", "total", "listed"]


@dataclass(frozen=True)
class _Rule:
    """How listed distances of two clusters combine, and their distance given ``absent``."""

    combine: Callable[[str], Column]
    gap: Callable[[Column], Column]


def _mean_gap(absent: Column) -> Column:
    cells = F.col("na") * F.col("nb")
    return (F.col("total") + (cells - F.col("listed")) * absent) / cells


def _extreme_gap(extreme: Callable[..., Column]) -> Callable[[Column], Column]:
    def gap(absent: Column) -> Column:
        whole = F.col("listed") == F.col("na") * F.col("nb")
        return F.when(whole, F.col("total")).otherwise(extreme(F.col("total"), absent))

    return gap


METHODS = {
    "average": _Rule(F.sum, _mean_gap),
    "complete": _Rule(F.max, _extreme_gap(F.greatest)),
    "single": _Rule(F.min, _extreme_gap(F.least)),
}


def _gap(rule: _Rule, absent: float) -> Column:
    """Distance of a cluster pair, rounded so that ties are ties."""
    return F.round(rule.gap(F.lit(absent)), 12)


def _closest(pairs: DataFrame) -> DataFrame:
    """The pairs that are each other's closest; the order on pairs is total, so one exists."""
    key = F.struct("gap", *_PAIR)
    nearest = (
        pairs.select(key.alias("pair"), F.explode(F.array("a", "b")).alias("end"))
        .groupBy("end")
        .agg(F.min("pair").alias("pair"))
    )
    return nearest.groupBy("pair").count().filter(F.col("count") == 2).select("pair.*")


def _merge_rows(chosen: DataFrame) -> DataFrame:
    """A merge is made one round after the later of its two parts."""
    return chosen.select(
        F.col("a").alias("left"),
        F.col("b").alias("right"),
        F.greatest("gap", "ha", "hb").alias("height"),
        (F.col("na") + F.col("nb")).alias("size"),
        (F.greatest("ra", "rb") + 1).alias("round"),
        F.col("ra").alias("left_round"),
        F.col("rb").alias("right_round"),
    )


def _renamed(merges: DataFrame) -> DataFrame:
    """``(old, new)``: what each end of the merges has become."""
    return merges.selectExpr(
        "explode(array(`left`, `right`)) AS old",
        "named_struct('id', `left`, 'n', size, 'h', height, 'r', round) AS new",
    )


def _apply(pairs: DataFrame, renamed: DataFrame, rule: _Rule) -> DataFrame:
    """Rewrite both ends of every pair to the merged clusters and re-aggregate."""
    for end in "ab":
        pairs = pairs.join(renamed.selectExpr(f"old AS {end}", f"new AS new_{end}"), end, "left")
    return (
        pairs.selectExpr(
            "coalesce(new_a, named_struct('id', a, 'n', na, 'h', ha, 'r', ra)) AS p",
            "coalesce(new_b, named_struct('id', b, 'n', nb, 'h', hb, 'r', rb)) AS q",
            "total",
            "listed",
        )
        .where("p.id <> q.id")
        .selectExpr(
            "CASE WHEN p.id < q.id THEN p ELSE q END AS x",
            "CASE WHEN p.id < q.id THEN q ELSE p END AS y",
            "total",
            "listed",
        )
        .groupBy("x", "y")
        .agg(rule.combine("total").alias("total"), F.sum("listed").alias("listed"))
        .selectExpr(
            "x.id AS a", "y.id AS b", "x.n AS na", "y.n AS nb", "x.h AS ha", "y.h AS hb",
            "x.r AS ra", "y.r AS rb", "total", "listed",
        )
    )


def _rounds(pairs: DataFrame, absent: float, below: float | None, rule: _Rule, done: list) -> DataFrame:
    """Merge closest pairs until none is left (closer than ``below`` when given).

    A round writes its merges and the rewritten pairs as one table.
    """
    while True:
        open_pairs = pairs.withColumn("gap", _gap(rule, absent))
        if below is not None:
            open_pairs = open_pairs.filter(F.col("gap") < below)
        merges = _merge_rows(_closest(open_pairs))
        kept = _apply(pairs, _renamed(merges), rule)
        seen = Observation()
        both = materialize(
            merges.select(F.struct(*merges.columns).alias("merge"), F.lit(None).cast(_struct_of(kept)).alias("pair"))
            .unionByName(kept.select(F.lit(None).cast(_struct_of(merges)).alias("merge"), F.struct(*kept.columns).alias("pair")))
            .observe(seen, F.count("merge").alias("merges"), F.count("pair").alias("pairs"))
        )
        pairs = both.where(F.col("pair").isNotNull()).select("pair.*")
        if seen.get["merges"] == 0:
            return pairs
        done.append(both.where(F.col("merge").isNotNull()).select("merge.*"))
        if seen.get["pairs"] == 0:
            return pairs


def _struct_of(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">"


def _clusters(words: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Current clusters ``(id, n, h, r)`` after the merges in ``done``."""
    singles = words.select(
        F.col("word").alias("id"),
        F.lit(1).cast("long").alias("n"),
        F.lit(0.0).alias("h"),
        F.lit(0).alias("r"),
    )
    if not done:
        return singles
    merges = _union(done)
    gone = merges.select(F.col("right").alias("id"))
    grown = merges.groupBy(F.col("left").alias("id")).agg(
        F.max(F.struct("round", "size", "height")).alias("m")
    )
    return (
        singles.join(gone, "id", "left_anti")
        .join(grown, "id", "left")
        .select(
            "id",
            F.coalesce("m.size", "n").alias("n"),
            F.coalesce("m.height", "h").alias("h"),
            F.coalesce("m.round", "r").alias("r"),
        )
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


# --- merges at the constant distance -------------------------------------------------


def _chain(clusters: DataFrame, height: float) -> DataFrame:
    """Join clusters one after the other, in order of name, at the same height."""
    last = clusters.agg(F.max("r")).scalar()
    placed = materialize(with_row_ids(clusters, ["id"], "_at"))
    sized = with_running_total(placed, ["_at"], "n", "_before")
    head = placed.filter(F.col("_at") == 0).select(
        F.col("id").alias("left"), F.col("r").alias("_first_round")
    )
    first = head.select("left").scalar()
    first_round = head.select("_first_round").scalar()
    return sized.filter(F.col("_at") > 0).select(
        first.alias("left"),
        F.col("id").alias("right"),
        F.greatest(F.lit(height), "h").alias("height"),
        (F.col("_before") + F.col("n")).alias("size"),
        (last + F.col("_at")).cast("int").alias("round"),
        F.when(F.col("_at") == 1, first_round)
        .otherwise(last + F.col("_at") - 1)
        .cast("int")
        .alias("left_round"),
        F.col("r").alias("right_round"),
    )


def _first_independent(clusters: DataFrame, far: DataFrame) -> DataFrame:
    """Ids of the first independent set by name: those without a smaller neighbour in the set.

    ``far(a, b)`` are the edges, ``a < b``. Every round takes what has no smaller neighbour left
    and strikes its neighbours out.
    """
    edges = materialize(far.select("a", "b"))
    state = materialize(clusters.select("id", F.lit(None).cast("boolean").alias("taken")))
    while True:
        open_ = state.where(F.col("taken").isNull()).select("id")
        live = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(
            open_.withColumnRenamed("id", "b"), "b", "left_semi"
        )
        held = live.select(F.col("b").alias("id"))
        free = materialize(open_.join(held, "id", "left_anti"))
        struck = live.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        news = free.select("id", F.lit(True).alias("now")).unionByName(struck.distinct().select("id", F.lit(False).alias("now")))
        seen = Observation()
        state = materialize(
            state.join(news, "id", "left").select("id", F.coalesce("taken", "now").alias("taken"))
            .observe(seen, F.count_if(F.col("taken").isNull()).alias("open"))
        )
        if not seen.get["open"]:
            return state.where("taken").select("id")


def _merge_absent(clusters: DataFrame, far: DataFrame, count: int, absent: float) -> DataFrame:
    """The merges at ``absent`` that the tie rule makes first, as one chain."""
    degree = far.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_deg"))
    partnered = materialize(
        clusters.join(degree, "id", "left").where(F.coalesce("_deg", F.lit(0)) < count - 1).drop("_deg")
    )
    chosen = _first_independent(partnered, far.join(partnered.select(F.col("id").alias("a")), "a", "left_semi")
                                .join(partnered.select(F.col("id").alias("b")), "b", "left_semi"))
    return materialize(_chain(materialize(partnered.join(chosen, "id", "left_semi")), absent))


def _renamed_chain(merges: DataFrame) -> DataFrame:
    """``(old, new)`` of a whole chain: all of it has become its last merge."""
    end = merges.agg(F.max(F.struct("round", "left", "size", "height")).alias("m")).select(
        F.struct(F.col("m.left").alias("id"), F.col("m.size").alias("n"), F.col("m.height").alias("h"), F.col("m.round").alias("r"))
    ).scalar()
    ends = merges.select(F.explode(F.array("left", "right")).alias("old")).distinct()
    return ends.select("old", end.alias("new"))


# --- spanning forest -----------------------------------------------------------------


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Lightest spanning forest of ``edges(a, b, distance)``, ``a < b``: a subset of the edges.

    Every round each component picks its lightest edge to another (ties by name, so the order is
    total and no cycle can close), and the components so joined become one. Rounds grow with the
    logarithm of the number of nodes.
    """
    edge = F.struct("distance", "a", "b")
    live = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), edge.alias("edge")))
    chosen = []
    while True:
        ends = live.select(F.col("x").alias("c"), F.col("y").alias("to"), "edge").unionByName(
            live.select(F.col("y").alias("c"), F.col("x").alias("to"), "edge")
        )
        best, n = materialize_counted(ends.groupBy("c").agg(F.min(F.struct("edge", "to")).alias("best")))
        if not n:
            break
        picked = best.select("c", F.col("best.to").alias("to"), "best.edge")
        chosen.append(picked.select("edge.*").distinct())
        # two components that picked the same edge point at each other: the smaller is the root
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("_back"))
        up = picked.join(back, "to", "left").select(
            "c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")
        )
        roots = _followed(up)
        for end in "xy":
            live = live.join(roots.select(F.col("c").alias(end), F.col("up").alias(f"_{end}")), end, "left")
        x, y = F.coalesce("_x", "x"), F.coalesce("_y", "y")
        live = materialize(
            live.where(x != y).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "edge")
            .groupBy("x", "y").agg(F.min("edge").alias("edge"))
        )
    none = edges.select("distance", "a", "b").limit(0)
    return (_union(chosen) if chosen else none).select("a", "b", "distance")


def _followed(up: DataFrame) -> DataFrame:
    """Follow ``(c, up)`` to the root of each by doubling the jumps."""
    now = materialize(up)
    while True:
        above = now.select(F.col("c").alias("up"), F.col("up").alias("_next"))
        seen = Observation()
        now = materialize(
            now.join(above, "up", "left")
            .select("c", F.coalesce("_next", "up").alias("up"), (F.coalesce("_next", "up") != F.col("up")).alias("moved"))
            .observe(seen, F.count_if("moved").alias("moved"))
        ).drop("moved")
        if not seen.get["moved"]:
            return now


# --- linkage -------------------------------------------------------------------------


def _no_merges(words: DataFrame) -> DataFrame:
    kind = words.schema["word"].dataType.simpleString()
    return words.sparkSession.createDataFrame(
        [],
        f"step bigint, left {kind}, right {kind}, height double, size bigint, round int, left_round int, right_round int",
    )


def _opened(distances: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    return distances.select(
        "a", "b",
        one.alias("na"), one.alias("nb"),
        F.lit(0.0).alias("ha"), F.lit(0.0).alias("hb"),
        F.lit(0).alias("ra"), F.lit(0).alias("rb"),
        F.col("distance").alias("total"), one.alias("listed"),
    )


def average_linkage(
    distances: DataFrame, absent: float, words: DataFrame | None = None, method: str = "average"
) -> DataFrame:
    """Merge tree of the words in ``distances(a, b, distance)``, ``a < b``.

    ``words(word)`` are all leaves; words without a listed distance (such as those that only
    occur with themselves) are ``absent`` from every other. Without it the leaves are the words
    of ``distances``. One word makes no merge, so the result is empty. ``method`` is
    ``average``, ``complete`` or ``single``.

    Returns ``(step, left, right, height, size, round, left_round, right_round)`` with steps
    from 1 to n-1 in order of height. ``left`` and ``right`` are the smallest words of the
    merged clusters; ``(left, left_round)`` names the merge that made the left cluster, round
    0 being a leaf. Of tied pairs the one with the smaller names merges first.
    """
    rule = METHODS[method]
    listed = distances.select(F.explode(F.array("a", "b")).alias("word"))
    words = materialize((listed if words is None else listed.union(words.select("word"))).distinct())
    done: list[DataFrame] = []
    below = absent - _EPSILON
    pairs = materialize(_opened(distances))
    if method == "single":
        near = materialize(spanning_forest(distances.where(F.round("distance", 12) < below)))
        _rounds(_opened(near), absent, None, _FOREST, done)
        if done:  # only now are the listed pairs between the components of interest
            pairs = materialize(_apply(pairs, _whole_renaming(words, done), rule))
    else:
        pairs = _rounds(pairs, absent, below, rule, done)
    while True:
        clusters, count = materialize_counted(_clusters(words, done))
        if count <= 1:
            break
        far, n_far = materialize_counted(
            pairs.withColumn("gap", _gap(rule, absent)).filter(F.col("gap") > absent + _EPSILON)
        )
        if n_far == 0:  # every remaining pair is at the constant distance
            done.append(materialize(_chain(clusters, absent)))
            break
        if n_far == count * (count - 1) // 2:
            _rounds(pairs, absent, None, rule, done)
            break
        chain = _merge_absent(clusters, far, count, absent)
        done.append(chain)
        pairs = materialize(_apply(pairs, _renamed_chain(chain), rule))
    if not done:
        return _no_merges(words)
    merges = _union(done)
    return with_row_ids(merges, ["height", "round", "left", "right"], "_at").select(
        (F.col("_at") + 1).alias("step"),
        "left", "right", "height", "size", "round", "left_round", "right_round",
    )


#: In a forest two clusters have one edge at most.
_FOREST = _Rule(F.min, lambda absent: F.col("total"))


def _whole_renaming(words: DataFrame, done: list[DataFrame]) -> DataFrame:
    """``(old, new)`` of every word after the merges in ``done``."""
    into = _union(done).select(F.col("right").alias("c"), F.col("left").alias("up"))
    up = words.join(into.withColumnRenamed("c", "word"), "word", "left").select(
        F.col("word").alias("c"), F.coalesce("up", "word").alias("up")
    )
    cluster = _clusters(words, done).select(F.col("id").alias("up"), F.struct("id", "n", "h", "r").alias("new"))
    return materialize(_followed(up).join(cluster, "up").select(F.col("c").alias("old"), "new"))


# --- cuts ----------------------------------------------------------------------------


def cut_by_distance(merges: DataFrame, threshold: float | Column) -> DataFrame:
    """Flat clusters ``(word, cluster)``: every merge of height <= ``threshold`` applies.

    Follows each word to the one it disappeared into by doubling the jumps, so the number
    of rounds is the logarithm of the longest chain.
    """
    limit = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    words = merges.select(F.explode(F.array("left", "right")).alias("word")).distinct()
    into = merges.filter(F.col("height") <= limit).select(
        F.col("right").alias("word"), F.col("left").alias("cluster")
    )
    labels = materialize(
        words.join(into, "word", "left").select(
            "word", F.coalesce("cluster", "word").alias("cluster")
        )
    )
    while True:
        jump = labels.select(F.col("word").alias("cluster"), F.col("cluster").alias("_next"))
        moved = materialize(labels.join(jump, "cluster").select("word", "cluster", "_next"))
        labels = moved.select("word", F.col("_next").alias("cluster"))
        if moved.filter(F.col("cluster") != F.col("_next")).isEmpty():
            return labels


def _height_at(merges: DataFrame, position: Column) -> Column:
    """Height of the merge at ``position`` counted from 1 in order of height."""
    return merges.filter(F.col("step") == position).agg(F.max("height")).scalar()


def count_threshold(merges: DataFrame, k: int) -> Column:
    """The k-1st largest height; cutting there (inclusive) leaves at most k-1 clusters."""
    n_merges = merges.agg(F.count(F.lit(1))).scalar()
    at = F.lit(1) if k <= 1 else n_merges - (k - 1) + 1
    return _height_at(merges, at)


def cut_by_count(merges: DataFrame, k: int) -> DataFrame:
    """Flat clusters at the lowest height that leaves at most ``k`` of them."""
    n_merges = merges.agg(F.count(F.lit(1))).scalar()
    height = _height_at(merges, n_merges - k + 1)
    return cut_by_distance(merges, F.coalesce(height, F.lit(-1.0)))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Words per cluster."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_count(labels: DataFrame) -> DataFrame:
    """Number of distinct clusters."""
    return labels.agg(F.count_distinct("cluster").alias("n_clusters"))


def sample_clusters(labels: DataFrame, max_display: int = 100, order: str = "word") -> DataFrame:
    """A share of every cluster in proportion to its size, at least one word each.

    All words when there are no more than ``max_display``. Shares round half to even.
    """
    n_words = labels.agg(F.count(F.lit(1))).scalar()
    share = F.bround(F.lit(max_display) * F.col("size") / n_words).cast("long")
    quota = F.when(n_words <= max_display, F.col("size")).otherwise(F.greatest(share, F.lit(1)))
    ranked = labels.withColumn(
        "rank", F.row_number().over(Window.partitionBy("cluster").orderBy(order))
    ).filter(F.col("rank") <= max(max_display, 1))  # a quota is never larger: prunes before the sort
    return (
        ranked.join(cluster_sizes(labels), "cluster")
        .filter(F.col("rank") <= quota)
        .select("cluster", order, "rank", "size")
    )


# --- tree tables ---------------------------------------------------------------------


def tree_nodes(merges: DataFrame) -> DataFrame:
    """Node table ``(node, label, parent, left, right, leaves, subtree, height, level)``.

    Leaves are numbered by word from 0, merges follow by step; the root has level 0.
    """
    words = materialize(
        with_row_ids(
            merges.select(F.explode(F.array("left", "right")).alias("word")).distinct(), ["word"], "node"
        )
    )
    n_words = words.agg(F.count(F.lit(1))).scalar()
    merges = materialize(merges)
    named = words.select(
        F.col("word").alias("name"), F.lit(0).alias("made"), "node"
    ).unionByName(
        merges.select(
            F.col("left").alias("name"),
            F.col("round").alias("made"),
            (n_words + F.col("step") - 1).alias("node"),
        )
    )
    named = materialize(named)
    left = named.select(
        F.col("name").alias("left"), F.col("made").alias("left_round"), F.col("node").alias("left_node")
    )
    right = named.select(
        F.col("name").alias("right"), F.col("made").alias("right_round"), F.col("node").alias("right_node")
    )
    inner = materialize(
        merges.join(left, ["left", "left_round"])
        .join(right, ["right", "right_round"])
        .select(
            (n_words + F.col("step") - 1).alias("node"),
            F.lit(None).cast("string").alias("label"),
            "left_node", "right_node",
            F.col("size").alias("leaves"),
            "height",
        )
    )
    leaves = words.select(
        "node",
        F.col("word").alias("label"),
        F.lit(None).cast("long").alias("left_node"),
        F.lit(None).cast("long").alias("right_node"),
        F.lit(1).cast("long").alias("leaves"),
        F.lit(0.0).alias("height"),
    )
    parents = inner.select(
        F.col("node").alias("parent"), F.explode(F.array("left_node", "right_node")).alias("node")
    )
    nodes = leaves.unionByName(inner).join(parents, "node", "left")
    return nodes.join(_levels(nodes.select("node", "parent")), "node").select(
        "node", "label", "parent", "left_node", "right_node", "leaves",
        (F.col("leaves") * 2 - 1).alias("subtree"), "height", "level",
    )


def _levels(nodes: DataFrame) -> DataFrame:
    """Depth of every node by doubling the jumps towards the root."""
    state = materialize(
        nodes.select(
            "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")
        )
    )
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        above = state.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_more")
        )
        state = materialize(
            state.join(above, "up", "left").select(
                "node", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level")
            )
        )
    return state.select("node", "level")


def truncated_tree(merges: DataFrame, p: int) -> DataFrame:
    """Leaves of the tree cut to its last ``p - 1`` merges: ``(cluster, leaves)``."""
    n_merges = merges.agg(F.count(F.lit(1))).scalar()
    last = materialize(merges.filter(F.col("step") > n_merges - (p - 1)))
    children = last.select(F.col("left").alias("cluster"), F.col("left_round").alias("round")).unionByName(
        last.select(F.col("right").alias("cluster"), F.col("right_round").alias("round"))
    )
    made = merges.select(F.col("left").alias("cluster"), "round", "size", "step")
    kept = last.select(F.col("left").alias("cluster"), "round")
    return (
        children.join(kept, ["cluster", "round"], "left_anti")
        .join(made, ["cluster", "round"], "left")
        .select("cluster", F.coalesce("size", F.lit(1)).alias("leaves"))
    )
