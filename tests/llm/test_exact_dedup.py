import hashlib
import re

from corpusloom.llm.exact_dedup import DigestIndex, kept_rows


def sha(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_batches(spark, table, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    one = table([(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "x"), (None, "x"), (None, "y"), (None, "y")],
                kept="no", digest=1, row=2, group_size="z")
    got = index.admit(one, "one").collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append((r.doc_id, r.keep_id, r.group_size, r.kept))
    assert sorted(by[sha("a b")]) == [(3, 3, 3, True), (5, 3, 3, False), (9, 3, 3, False)]
    assert sorted(by[sha("")]) == [(1, 1, 2, True), (2, 1, 2, False)]
    assert by[sha(" ")] == [(4, 4, 1, True)]
    assert sorted(by[sha("x")], key=str) == [(7, 7, 2, True), (None, 7, 2, False)]
    assert sorted(x[3] for x in by[sha("y")]) == [False, True]

    two = table([(11, "a b"), (12, "new"), (13, "new")])
    want = [(11, 3, 1, False), (12, 12, 2, True), (13, 12, 2, False)]
    for _ in range(2):  # the second time as after a failure
        got = index.admit(two, "two").collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert index.rows().count() == index.rows().select("digest").distinct().count() == 6
    again = DigestIndex(spark, str(tmp_path / "index"), 4)
    assert again.rows().count() == 6


def test_empty(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    assert index.admit(spark.createDataFrame([], "doc_id bigint, text string"), "none").count() == 0


def test_kept_rows(spark, table, tmp_path):
    docs = table([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (None, "d"), (None, "d"), (4, None)], d="clash", _id=3)
    verdicts = DigestIndex(spark, str(tmp_path / "index"), 4).admit(docs, "x")
    got = sorted(((r.doc_id, r.text) for r in kept_rows(docs, verdicts).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (3, "c"), (None, "d"), (4, None)], key=str)
    assert kept_rows(docs, verdicts).columns == docs.columns
