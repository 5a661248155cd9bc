from corpusloom.operators import pairs

TEXTS = [
    "Only one long sentence here.",
    "First long sentence. Second long sentence. Third long sentence.",
    ". ".join(f"Sentence number {i:03d}" for i in range(12)),
    "",
    ". ".join(f"Another sentence {i:03d}" for i in range(4)),
    "tiny. bits. only.",
] * 5


def draw(doc, i, salt):
    x = (doc * 7_919_017 + i * 104_729_011 + salt * 15_485_863) % 2_147_483_579
    y = (doc * 32_452_843 + i * 49_979_687 + salt * 86_028_121) % 2_147_483_549
    return pow(x, 3, 2_147_483_579) * 2_147_483_549 + pow(y, 3, 2_147_483_549)


def plain(rows, seed=42):
    split = {d: [s.strip() for s in t.split(".") if len(s.strip()) > 10] for d, t in rows}
    ids = sorted(split)
    out = set()
    for d in ids:
        s = split[d]
        n = len(s)
        if n < 3:
            continue
        for i in range(n - 1):
            out.add((d, i, "adjacent", s[i], s[i + 1], 0.8))
            if n > 3 and i < n - 2:
                out.add((d, i, "skip", s[i], s[i + 2], 0.4))
            if draw(d, i, seed + 1) < 700 * (2_147_483_579 * 2_147_483_549 // 1000) and n > 5:
                low = min(i + 3, n - 1)
                j = low + draw(d, i, seed + 2) % (n - low)
                if j > i + 2:
                    out.add((d, i, "far", s[i], s[j], 0.2))
            else:
                other = split[ids[draw(d, i, seed + 3) % len(ids)]]
                if other:
                    out.add((d, i, "other", s[i], other[draw(d, i, seed + 4) % len(other)], 0.1))
    return out


def test_pairs_match_nested_loops(spark):
    rows = [(100 + 7 * i, t) for i, t in enumerate(TEXTS)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [tuple(r) for r in pairs.training_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_cap_is_exact_and_split_is_disjoint(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs.training_pairs(df, max_samples=17).count() == 17
    whole = sorted((d, i, k) for d, i, k, *_ in plain(rows))
    split = {(r.doc_id, r.i, r.kind): r.split for r in pairs.split_pairs(pairs.training_pairs(df)).collect()}
    held = [k for k in whole if split[k] == "eval"]
    assert len(split) == len(whole) and held == whole[: len(whole) // 10]
    few = pairs.split_pairs(pairs.training_pairs(df), most=3).filter("split = 'eval'").count()
    assert few == 3


def test_draws_do_not_run_out(spark):
    """Far more different draws than two fields of a million; ids a prime apart differ."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 300_000).select(pairs.draw(F.col("id") * 1_000_003, F.col("id") % 7, 3).alias("x"))
    assert rows.distinct().count() == 300_000
    got = rows.agg(F.count_distinct(F.col("x") % 10_000_000)).first()[0]
    assert got > 290_000
