"""Named queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    byte_cnn,
    context_tree,
    count_streams,
    cube_mixing,
    exact_dedup,
    fm_index,
    jaccard_join,
    length_buckets,
    license_index,
    merkle_manifest,
    page_templates,
    secret_battery,
    toxicity_chain,
)
from corpusloom.runtime import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_model(doc_id):
    """Rows the language model never learns from; a null id is one of them."""
    return F.coalesce(remainder(doc_id, 7) == 2, F.lit(True))


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return context_tree.score_corpus(_table(spark, sf_dir, "documents"), held_out_model)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_templates.extract(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents admitted to a new digest index."""
    index = exact_dedup.DigestIndex(
        spark, f"{scratch_dir(spark)}/digests-{uuid.uuid4().hex}", buckets=64
    )
    return index.admit(_table(spark, sf_dir, "documents"), batch="documents")


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return length_buckets.pack(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents."""
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secret_battery.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int, name: str):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(name)

    return found.select(
        "doc_id",
        count(0, "n_assign"),
        count(1, "n_access"),
        count(2, "n_hex"),
        F.sha2(secret_battery.span_text(base), 256).alias("base_sha256"),
        secret_battery.span_text(F.col("spans")).alias("spans"),
        count(3, "n_random"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = license_index.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_union(base, F.transform("found", lambda f: f["label"]))
    starts = F.transform("places", lambda p: p["start"])
    best = F.array_max(F.transform("found", lambda f: f["share"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        # a phrase without a notice around it is half a proof
        F.coalesce(best, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def hit_words(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_words, n_hit):
    """The rule for a whole document: at least a twentieth of its words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = fm_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", hit_words("spans").alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def remainder(doc_id, by: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def held_out_quality(doc_id):
    """Rows the quality network never learns from; a null id is one of them."""
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(True))


def quality_network(spark: SparkSession, sf_dir: str) -> byte_cnn.Network:
    return byte_cnn.train(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", held_out_quality
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = byte_cnn.score_texts(_table(spark, sf_dir, "documents"), quality_network(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out_quality(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


#: Categories of the chain, first to last.
TOXICITY = {
    "p_low_quality": "quality = 0",
    "p_toxic": "toxic = 1",
    "p_toxic_low_quality": "quality = 0 AND toxic = 1",
}


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    models = toxicity_chain.train(docs, _table(spark, sf_dir, "labels"), TOXICITY, held_out_quality)
    scored = toxicity_chain.score_texts(docs, models, list(TOXICITY))
    return scored.select(
        "doc_id",
        held_out_quality(F.col("doc_id")).alias("held_out"),
        F.col("p_toxic").alias("score"),
        (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"),
        *TOXICITY,
    )


#: What makes a leaf of the manifest.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, half of them met without their line ends."""
    docs = _table(spark, sf_dir, "documents")
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    met = merkle_manifest.leaf_digest(*[bare if c == "text" else F.col(c) for c in LEAF])
    tampered = (remainder(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n"))
    return merkle_manifest.manifest(docs, F.when(tampered, met), fields=LEAF)


def op12_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to target weights of their sources."""
    return cube_mixing.mix(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of every language of the documents."""
    return count_streams.collocations(_table(spark, sf_dir, "documents"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_context_tree,
    op2_page_text,
    op3_exact_dedup,
    op4_length_buckets,
    op5_jaccard_join,
    op6_toxicity,
    op7_secrets,
    op8_licenses,
    op9_decontamination,
    op10_quality,
    op11_manifest,
    op12_cube_mix,
    op13_collocations,
]

_WORDS = (
    r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_SPACED = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)

SQL = {
    "op11_manifest": r"""
WITH RECURSIVE field AS (
  SELECT doc_id, source, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS bare,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) END AS found
  FROM field
), tree AS (
  SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS tree, count(*) AS n FROM leaf GROUP BY source
), placed AS (
  SELECT doc_id, tree, n, leaf, coalesce(found, leaf) AS found,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id IS NULL, doc_id, leaf) - 1 AS idx
  FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source
), node AS (
  SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1
  GROUP BY tree, lvl, n, idx // 3
), sub AS (SELECT tree, lvl AS height, h AS subroot FROM node WHERE n = 1),
peak AS (
  SELECT 0 AS lvl, tree AS idx, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM peak WHERE n > 1 GROUP BY lvl, n, idx // 3
), step AS (
  SELECT doc_id, idx, tree, leaf, found, unnest(range(0, height)) AS lvl, 0 AS part FROM placed JOIN sub USING (tree)
  UNION ALL
  SELECT doc_id, idx, tree, leaf, found, unnest(range(0, (SELECT max(lvl) FROM peak))), 1 FROM placed
), power AS (SELECT k AS lvl, CAST(pow(3, k) AS BIGINT) AS w FROM (SELECT unnest(range(0, 33)) AS k)),
spot AS (
  SELECT doc_id, s.idx AS leaf_idx, tree, part, s.lvl, (CASE WHEN part = 0 THEN s.idx ELSE tree END) // w AS i
  FROM step s JOIN power USING (lvl)
), every AS (SELECT 0 AS part, tree, lvl, idx, h FROM node UNION ALL SELECT 1, 0, lvl, idx, h FROM peak),
side AS (
  SELECT a.doc_id, a.leaf_idx, a.tree, a.part, a.lvl, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx < a.i), '') AS l,
    coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx > a.i), '') AS r
  FROM spot a JOIN every e ON e.part = a.part AND e.tree = CASE WHEN a.part = 0 THEN a.tree ELSE 0 END
    AND e.lvl = a.lvl AND e.idx // 3 = a.i // 3
  GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY part, lvl) AS k FROM side
), proof AS (
  SELECT tree, leaf_idx AS idx, string_agg(l || r, '' ORDER BY k) AS said FROM numbered GROUP BY ALL
), folded AS (
  SELECT tree, idx, 0::BIGINT AS k, found AS h FROM placed
  UNION ALL
  SELECT f.tree, f.idx, f.k + 1, sha256(l || f.h || r) FROM folded f JOIN numbered m ON m.tree = f.tree AND m.leaf_idx = f.idx AND m.k = f.k + 1
), ended AS (SELECT tree, idx, arg_max(h, k) AS folded_root FROM folded GROUP BY ALL),
top AS (SELECT h AS root FROM peak WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(said, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN sub USING (tree) LEFT JOIN proof USING (tree, idx) JOIN ended USING (tree, idx), top
""",
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + m - 1] AS g, m FROM (SELECT lang, w, i, unnest(range(1, 6)) AS m FROM starts)
          WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_parts AS (
  SELECT lang, g[i:i + k - 1] AS g, a
  FROM (SELECT lang, g, m, a, k, unnest(range(1, m - k + 2)) AS i
        FROM (SELECT lang, g, m, a, unnest(range(2, m)) AS k FROM f WHERE m > 2))
), longer AS (SELECT lang, g, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, g) WHERE m > 1 AND (longer IS NULL OR longer < a)),
cuts AS (SELECT lang, g, m, a, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS cut FROM scored) WHERE cut = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM weakest
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
""",
    "op5_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
      FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * both_have >= 80 * (nx.n + ny.n - both_have)),
reach(doc_id, r) AS (SELECT x, y FROM l UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.r),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[k:k + 12] AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
doc_win AS (
  SELECT doc_id, k, n, w[k:k + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, k, win.n AS n FROM doc_win JOIN win USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS said
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h)
""",
}
