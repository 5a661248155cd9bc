import random
from collections import Counter

import pytest

from corpusloom.operators import corpus, word_pairs


def lists(n=150):
    rng = random.Random(11)
    words = ["a", "b", "c", "dé", "e", *[f"w{i}" for i in range(40)], None]
    return [[rng.choice(words[: rng.choice([4, 46])]) for _ in range(rng.choice([0, 1, 2, 9, 40]))] for _ in range(n)] + [None]


def brute(rows, window, least):
    seen = Counter()
    for r in rows:
        r = r or []
        seen.update((r[i], r[j]) for i in range(len(r)) for j in range(i + 1, min(i + window, len(r))) if r[i] and r[j])
    return {p: n for p, n in seen.items() if n >= least}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(r,) for r in rows], "tokens array<string>").repartition(parts)


@pytest.mark.parametrize("listed", [0, 3, 1000])
@pytest.mark.parametrize("window, least", [(2, 1), (10, 1), (10, 10)])
def test_counts_with_a_short_word_list(spark, listed, window, least, monkeypatch):
    monkeypatch.setattr(word_pairs, "_LIST_WORDS", listed)
    monkeypatch.setattr(word_pairs, "_BLOCK_TOKENS", 64)
    rows = lists()
    got = corpus.cooccurrence(frame(spark, rows), window=window, min_freq=least).collect()
    assert {(r.word1, r.word2): r.n_pair for r in got} == brute(rows, window, least) and len(got) == len(set(got))


@pytest.mark.parametrize("rows", [[], [None, []], [["a"]], [[None, None]]])
def test_no_pairs(spark, rows):
    assert corpus.cooccurrence(frame(spark, rows)).collect() == []
    assert corpus.pmi(frame(spark, rows)).collect() == []


def test_pairs_leave_a_task_packed(spark):
    """Not one row a pair: every block hands on one row for each part it has pairs of."""
    plan = corpus.cooccurrence(frame(spark, lists()))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan
    numbers = [5, 0, 1 << 40, 5]
    assert word_pairs._unpack(word_pairs._pack(word_pairs.np.array(numbers))).tolist() == numbers
    near = word_pairs._pack(word_pairs.np.arange(100_000) % 200)
    assert len(near) < 100_000


def test_words_that_cannot_reach_the_least_count_are_not_listed(spark):
    rows = [["hot", f"once{i}", "hot", None] for i in range(30)] + [["twice", *["hot"] * 5], ["x", "x", "x"]]
    df = frame(spark, rows)
    words = corpus.word_counts(df)
    able = word_pairs._able_words(df, words, "tokens", 9, 10, None)
    assert {r.word for r in able.collect()} == {"hot"}
    across = spark.createDataFrame([("x", "y")] * 7, "word1 string, word2 string")
    able = word_pairs._able_words(df, words, "tokens", 9, 10, across)
    assert {r.word for r in able.collect()} == {"hot", "x"}


def test_bounds_of_places_hold():
    rng, np = random.Random(5), word_pairs.np
    for reach in [1, 2, 5, 9] * 20:
        codes = np.array([rng.randrange(-1, rng.choice([2, 9])) for _ in range(40)])
        row = np.sort(np.array([rng.randrange(3) for _ in codes]))
        for way in (1, -1):
            more = word_pairs._more_than_places(codes, row, reach)[0 if way == 1 else 1]
            for i in np.flatnonzero(codes >= 0):
                near = [i + way * s for s in range(1, reach + 1) if 0 <= i + way * s < len(codes)]
                seen = Counter(int(codes[j]) for j in near if row[j] == row[i] and codes[j] >= 0)
                assert max(seen.values(), default=0) <= more[i] + 1


def test_parts_are_ranges_of_about_one_size(spark):
    frequency = word_pairs.np.array([1000, 10, 10, 5, 1, 1])
    borders = word_pairs._borders(frequency, 8)
    assert len(borders) == 7 and (word_pairs.np.diff(borders) >= 0).all()
    assert (borders >> word_pairs._BITS).max() == 0  # the hot word's pairs are cut by their partner
    keys = word_pairs.np.array([3, 1 << 40, (1 << 40) + 2])
    assert word_pairs._unpack_keys(word_pairs._pack_keys(keys)).tolist() == keys.tolist()


def test_large_counts_are_summed():
    np = word_pairs.np
    keys, counts = np.array([7, 3, 7, 3]), np.array([1, 2, 1 << 40, 3])
    for n in (counts, np.array([1, 2, 4, 3])):
        got = word_pairs._summed(keys, n)
        assert [x.tolist() for x in got] == [[3, 7], [5, int(n[0] + n[2])]]


@pytest.mark.parametrize("listed", [3, 1000])
@pytest.mark.parametrize("least", [2, 5, 10])
def test_stream_counts_with_least_count(spark, listed, least, monkeypatch):
    monkeypatch.setattr(word_pairs, "_LIST_WORDS", listed)
    rows = [(i, r) for i, r in enumerate(lists(120))]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    got = corpus.cooccurrence_stream(df, ["doc_id"], min_freq=least).collect()
    stream = [t for _, r in rows for t in r or []]
    assert {(r.word1, r.word2): r.n_pair for r in got} == brute([stream], 10, least) and len(got) == len(set(got))


def test_only_pairs_of_able_words_travel_as_words(spark, monkeypatch):
    """With a full list, words under the least count stay at home and listed pairs are not counted again."""
    monkeypatch.setattr(word_pairs, "_LIST_WORDS", 1)
    rows = [["hot", "hot", f"once{i}", "warm", f"rare{i}", "hot"] for i in range(40)]
    got = corpus.cooccurrence(frame(spark, rows, 1), min_freq=10).collect()
    assert {(r.word1, r.word2): r.n_pair for r in got} == brute(rows, 10, 10)
    array = word_pairs.np.array
    words = ["hot", "warm", "once", "able"]
    local = array([0, 2, 1, 0, 0, 0, 2, 0, 3])
    pairs = word_pairs._other_pairs(local, array([0] * 9), 0, 9, 2, array([0, -1, -1, 1]), array([False, True, False, False]))
    assert [(words[a], words[b], n) for a, b, n in zip(*pairs)] == [("hot", "warm", 1), ("warm", "hot", 2)]


def test_marks_hold_every_word(spark):
    np = word_pairs.np
    words = [f"w{i}" for i in range(5000)]
    marks = word_pairs._marks(spark.createDataFrame([(w,) for w in words], "word string").repartition(3))
    assert len(marks) * 8 == word_pairs._MARKS
    hashes = lambda w: word_pairs._hashes(word_pairs.pa.array(w))
    assert word_pairs._marked(marks, hashes(words), word_pairs._MARKS).all()
    assert word_pairs._marked(marks, hashes([f"x{i}" for i in range(5000)]), word_pairs._MARKS).sum() < 50
    assert not np.unpackbits(word_pairs._marks(spark.createDataFrame([], "word string"))).any()


def test_blocks_bring_the_sums_of_their_words(spark):
    """The words are bounded while they are numbered; the pass over the bounds reads no token."""
    rows = [(r,) for r in lists(60)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    blocks = word_pairs.materialize(word_pairs.number_tokens(df, "tokens", 9))
    able = word_pairs._able_words(blocks, None, "_block", 9, 10, None)
    plan = able._jdf.queryExecution().executedPlan().toString()
    assert "sums:binary" in plan and "codes:binary" not in plan
    want = word_pairs._able_words(df, None, "tokens", 9, 10, None)
    assert sorted(map(tuple, able.collect())) == sorted(map(tuple, want.collect())) != []
