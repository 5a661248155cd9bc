import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpusloom.llm import byte_cnn
from corpusloom.llm.queries import held_out_quality
from test_decontamination import brute as hits
from test_exact_dedup import sha
from test_jaccard_join import brute as classes
from test_packing import padding

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    net = byte_cnn.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", held_out_quality)
    good = byte_cnn.scores(net, pa.array([t for _, t in rows])) >= 0.5
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    seen, kept = set(), []
    for d, t in sorted(rows):
        if sha(t) not in seen:
            seen.add(sha(t))
            kept.append((d, t))
    alone = [d for d, _, c in classes(kept) if d == c]
    kept = [(d, t) for d, t in kept if d in set(alone)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for d, t in kept:
        n, hit, _ = hits(t, items)
        if not (hit and 20 * len(hit) >= n):
            clean.append((d, t))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in clean]
    words = {d: len((t or "").split()) for d, t in clean}
    assert all(abs(r.n_tokens - words[r.doc_id]) <= 2 for r in got)  # str.split knows more spaces
    lengths = sorted({r.n_tokens for r in got})
    counts = [sum(r.n_tokens == x for r in got) for x in lengths]
    bounds = sorted({r.bucket_length for r in got})
    assert sum(r.padding for r in got) >= padding(lengths, counts, np.array(lengths) * counts, bounds)


def test_odd_rows(spark, table):
    """Null and repeated ids, clashing names: a class keeps one row, other rows stay."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " tail"
    docs = table([(5, near), (3, text), (None, near + "s"), (5, "a clean text of its own"), (None, None), (None, "")], n=1, grp="x", digest=0)
    got = corpus_pipeline.near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(3, text), (5, "a clean text of its own"), (None, None), (None, "")], key=str)
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.benchmark_passages):
        assert stage(spark, docs, SF).columns == docs.columns


def test_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
