"""SQL (DuckDB dialect) that each named query must agree with.

Written from the meaning of the operators, not from their Spark expressions: position
self-joins instead of generators, cross products instead of block joins, and so on.
"""

from __future__ import annotations

import re

from corpusloom.functions.stopwords import LANGUAGE_OF_CODE, stop_words
from corpusloom.functions.text import ABBREVIATIONS, FUSED_WORDS, SENTENCE_STARTERS
from corpusloom.operators.pairs import ADJACENT, FAR, OTHER, SKIP_ONE
from corpusloom.plans.catalog import LEXICON_CHARACTERS, LEXICON_PLACES, MAX_WORDS

_STOP = "'" + "', '".join(stop_words("english")) + "'"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _either(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


# --- building blocks -----------------------------------------------------------------


def _cleaned(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(lower({text}), '\\p{{P}}+', '', 'g')), "
        "'[^a-zA-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )


def _words(cleaned: str) -> str:
    spaced = cleaned
    for pair in FUSED_WORDS:
        head, tail = pair.split("|")
        spaced = f"regexp_replace({spaced}, '\\b({head})({tail})\\b', '\\1 \\2', 'gi')"
    return f"list_filter(string_split({spaced}, ' '), lambda t: t <> '')"


def _kept(tokens: str, stop: str = _STOP) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains([{stop}], t))"


def _search_tokens(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), '\\s+'), lambda t: trim(t, '{_PUNCT}')), "
        f"lambda t: t <> '' AND NOT list_contains([{_STOP}], t))"
    )


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _sentences(text: str) -> str:
    """Mark every boundary, take back the marks after abbreviations, initials and ellipses."""
    edge = "(^|[^\\p{L}\\p{N}_.])"
    abbreviation = f"((?i:{_either(ABBREVIATIONS)})\\.)"
    starters = _either([s[0].upper() + s[1:] for s in SENTENCE_STARTERS])
    x = f"regexp_replace({text}, '([.!?][\"'')\\]]{{0,3}})(\\s+)', '\\1' || chr(1) || '\\2', 'g')"
    x = f"regexp_replace({x}, '{edge}{abbreviation}\\x01(\\s+(?:{starters})(?:[^\\p{{L}}]|$))', '\\1\\2' || chr(2) || '\\3', 'g')"
    x = f"regexp_replace({x}, '{edge}{abbreviation}\\x01', '\\1\\2', 'g')"
    for _ in range(2):  # twice: the capital of one match can be the initial of the next
        x = f"regexp_replace({x}, '{edge}(\\p{{Lu}}\\.)[\\x01\\x02](\\s+\\p{{Lu}})', '\\1\\2\\3', 'g')"
    x = f"regexp_replace({x}, '(\\.\\.)\\x01(\\s+[\"''(\\[]{{0,3}}\\p{{Lu}})', '\\1' || chr(2) || '\\2', 'g')"
    x = f"regexp_replace({x}, '\\.\\.\\x01', '..', 'g')"
    parts = f"regexp_split_to_array({x}, '[\\x01\\x02]\\s+')"
    return f"list_filter(list_transform({parts}, lambda s: {_strip('s')}), lambda s: s <> '')"


def _naive(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, '.'), lambda s: {_strip('s')}), lambda s: length(s) > 10)"


def _mentions(text: str, lexicon) -> str:
    found = ", ".join(
        f"CASE WHEN regexp_matches({text}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){re.escape(n).replace(chr(92) + ' ', ' ')}"
        f"($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN '{n}' END"
        for n in lexicon
    )
    return f"list_filter([{found}], lambda n: n IS NOT NULL)"


_TOKENS = f"toks AS (SELECT doc_id, {_kept(_words(_cleaned('text')))} AS tokens FROM documents)"
_SENTENCE_ROWS = (
    f"arrs AS (SELECT doc_id, source, {_sentences('text')} AS s FROM documents), "
    "sents AS (SELECT doc_id, source, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_id FROM arrs)"
)
_STREAM = "flat AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks)"
_PAIRS_DOC = (
    f"{_TOKENS}, {_STREAM}, pairs AS (SELECT a.word AS word1, b.word AS word2, count(*) AS n_pair FROM flat a "
    "JOIN flat b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 9 GROUP BY ALL HAVING count(*) >= 10)"
)
_PAIRS_CORPUS = (
    f"{_TOKENS}, {_STREAM}, line AS (SELECT word AS word1, unnest(["
    + ", ".join(f"lead(word, {n}) OVER (ORDER BY doc_id, pos)" for n in range(1, 10))
    + "]) AS word2 FROM flat), "
    "pairs AS (SELECT word1, word2, count(*) AS n_pair FROM line WHERE word2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)"
)
_WORDS = "words AS (SELECT word, count(*) AS frequency FROM flat GROUP BY word), total AS (SELECT sum(frequency)::DOUBLE AS n FROM words)"


def _scored(pairs: str, score: str = "log2(n_pair / 9.0 * n) - log2(a.frequency::DOUBLE * b.frequency)") -> str:
    return (
        f"{pairs}, {_WORDS}, assoc AS (SELECT word1, word2, n_pair, {score} AS mi_score FROM pairs "
        "JOIN words a ON a.word = word1 JOIN words b ON b.word = word2, total)"
    )


_ASSOC = _scored(_PAIRS_DOC)
_MATRIX = (
    f"{_ASSOC}, mat AS (SELECT least(word1, word2) AS a, greatest(word1, word2) AS b, min(mi_score) AS mi FROM assoc GROUP BY ALL), "
    "voc AS (SELECT count(DISTINCT w) AS n FROM (SELECT a AS w FROM mat UNION ALL SELECT b FROM mat)), "
    "lim AS (SELECT CASE WHEN sum(CASE WHEN a = b THEN 1 ELSE 2 END) < any_value(n) * any_value(n) THEN least(min(mi), 0) ELSE min(mi) END AS lo, "
    "CASE WHEN sum(CASE WHEN a = b THEN 1 ELSE 2 END) < any_value(n) * any_value(n) THEN greatest(max(mi), 0) ELSE max(mi) END AS hi, "
    "any_value(n) AS n_words FROM mat, voc)"
)
_STRENGTH = (
    "strength AS (SELECT word, round(sum(mi_score), 6) AS strength FROM (SELECT word1 AS word, mi_score FROM assoc "
    "UNION ALL SELECT word2, mi_score FROM assoc) GROUP BY word)"
)


def _scale(x: str) -> str:
    return f"1.0 - CASE WHEN hi > 0 THEN CASE WHEN hi = lo THEN {x} - lo ELSE ({x} - lo) / (hi - lo) END ELSE {x} END"


_KEYWORDS = "queries AS (SELECT item_id AS query_id, regexp_split_to_array(text, '\\s+')[2:4] AS keywords FROM benchmark)"
_EXACT = (
    f"{_KEYWORDS}, hits AS (SELECT query_id, doc_id, text, keywords FROM queries, documents "
    "WHERE len(list_filter(keywords, lambda k: NOT contains(lower(text), lower(k)))) = 0)"
)
_BM25 = (
    f"d AS (SELECT doc_id, {_search_tokens('text')} AS tokens FROM documents), "
    "flat AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS word FROM d), "
    "tf AS (SELECT doc_id, dl, word, count(*) AS tf FROM flat GROUP BY ALL), "
    "corp AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), "
    "freq AS (SELECT word, count(*) AS df FROM tf GROUP BY word), "
    "raw AS (SELECT word, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM freq, corp), "
    "idfs AS (SELECT word, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"
)
_BM25_TOP = (
    f"{_BM25}, q AS (SELECT item_id AS query_id, unnest({_search_tokens('text')}) AS word FROM benchmark), "
    "sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score "
    "FROM q JOIN tf USING (word) JOIN idfs USING (word), corp GROUP BY ALL), "
    "allsc AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN d "
    "LEFT JOIN sc ON sc.query_id = b.item_id AND sc.doc_id = d.doc_id)"
)


def _unit(v: str) -> str:
    return f"list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"


_UNITS = f"u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, {_unit('embedding')} AS v FROM embeddings)"
_CENTRAL = (
    f"{_UNITS}, sc AS (SELECT a.label, a.vec_id, avg(list_dot_product(a.v, b.v)) AS s FROM u a JOIN u b ON a.label = b.label GROUP BY ALL)"
)


def _profile(text: str) -> str:
    letters = ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
    return f"[{letters}]::DOUBLE[]"


def _cos(a: str, b: str) -> str:
    zero = f"list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0"
    return f"CASE WHEN {zero} THEN 0.0 ELSE list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})) END"


_DOC_PROFILES = f"dp AS (SELECT doc_id, text, {_profile('lt')} AS v FROM (SELECT doc_id, text, lower(text) AS lt FROM documents))"


def _vector_hits(queries: str, k: int) -> str:
    """``queries`` yields (query_id, qtext)."""
    return (
        f"{_DOC_PROFILES}, qp AS (SELECT query_id, {_profile('qt')} AS qv FROM (SELECT query_id, lower(qtext) AS qt FROM ({queries}))), "
        f"sims AS (SELECT query_id, doc_id, text, round({_cos('qv', 'v')}, 6) AS score FROM qp, dp), "
        f"vhits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims "
        f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"
    )


_RERANKED = (
    f"{_vector_hits('SELECT item_id AS query_id, text AS qtext FROM benchmark', 32)}, "
    f"qd AS (SELECT item_id AS query_id, list_distinct({_search_tokens('text')}) AS qt FROM benchmark), "
    f"rr AS (SELECT query_id, doc_id, score, text, round(CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, {_search_tokens('text')}))::DOUBLE / len(qt) END, 6) AS cross_score "
    "FROM vhits JOIN qd USING (query_id)), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, doc_id) AS rank FROM rr "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, doc_id) <= 3)"
)


def _draw(doc: str, i: str, salt: int) -> str:
    fields = []
    for p, (a, b, c) in ((2147483579, (7919017, 104729011, 15485863)), (2147483549, (32452843, 49979687, 86028121))):
        x = f"((({doc} % {p}) * {a} + ({i} % {p}) * {b} + {(42 + salt) * c}::BIGINT) % {p})"
        fields.append(f"({x} * {x} % {p} * {x} % {p})")
    return f"({fields[0]} * 2147483549 + {fields[1]})"


_TRAINING = (
    f"d AS (SELECT doc_id, {_naive('text')} AS s, row_number() OVER (ORDER BY doc_id) - 1 AS doc_no FROM documents), "
    "tot AS (SELECT count(*) AS total FROM d), "
    "st0 AS (SELECT doc_id, s, len(s) AS n, unnest(range(0, len(s) - 1)) AS i FROM d WHERE len(s) >= 3), "
    f"st AS (SELECT *, {_draw('doc_id', 'i', 1)} < {700 * (2147483579 * 2147483549 // 1000)} AND n > 5 AS stays, least(i + 3, n - 1) AS low, "
    f"{_draw('doc_id', 'i', 2)} AS d2, {_draw('doc_id', 'i', 3)} AS d34, {_draw('doc_id', 'i', 4)} AS d5 FROM st0), "
    "st2 AS (SELECT *, low + d2 % (n - low) AS far FROM st), "
    "tp AS ("
    f"SELECT doc_id, i, 'adjacent' AS kind, s[i + 1] AS text_a, s[i + 2] AS text_b, {ADJACENT}::DOUBLE AS label FROM st2 "
    f"UNION ALL SELECT doc_id, i, 'skip', s[i + 1], s[i + 3], {SKIP_ONE}::DOUBLE FROM st2 WHERE n > 3 AND i < n - 2 "
    f"UNION ALL SELECT doc_id, i, 'far', s[i + 1], s[far + 1], {FAR}::DOUBLE FROM st2 WHERE stays AND far > i + 2 "
    f"UNION ALL SELECT st2.doc_id, i, 'other', st2.s[i + 1], d.s[d5 % len(d.s) + 1], {OTHER}::DOUBLE FROM st2 JOIN tot ON true "
    "JOIN d ON d.doc_no = d34 % total WHERE NOT stays AND total > 1 AND len(d.s) > 0)"
)

_BOOKS = (
    "books AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p, i: 'Chapter ' || i || ' ' || p), chr(10)) AS text FROM documents)"
)


def _chapters(heading: str) -> str:
    return (
        f"WITH {_BOOKS}, parts AS (SELECT doc_id, regexp_extract_all(text, '{heading}') AS titles, regexp_split_to_array(text, '{heading}') AS bodies FROM books), "
        "rows AS (SELECT doc_id, generate_subscripts(titles, 1) AS chapter_no, unnest(titles) AS title, unnest(bodies[2:]) AS content FROM parts) "
        f"SELECT doc_id, chapter_no, title, {_strip('content')} AS content FROM rows WHERE {_strip('content')} <> ''"
    )


_TAGGED = (
    f"{_SENTENCE_ROWS}, tagged AS (SELECT doc_id, sentence_id, sentence, {_mentions('lower(sentence)', LEXICON_CHARACTERS)} AS c, "
    f"{_mentions('lower(sentence)', LEXICON_PLACES)} AS p FROM sents)"
)
_FIRST_CENTER = (
    f"{_UNITS}, parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), "
    "means AS (SELECT label, dim, avg(x) AS x FROM parts GROUP BY ALL), "
    "ctr AS (SELECT label AS query_id, list(x ORDER BY dim) AS c FROM means GROUP BY label)"
)
_CHAPTERED = (
    "vec AS (SELECT label AS chapter, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings), "
    f"txt AS (SELECT conv_id AS chapter, turn AS idx, text AS sentence, array_to_string({_mentions('lower(text)', LEXICON_CHARACTERS)}, ', ') AS character, "
    f"array_to_string({_mentions('lower(text)', LEXICON_PLACES)}, ', ') AS place FROM conversations)"
)


_ALIGNED = (
    f"WITH {_CHAPTERED}, cnt AS (SELECT chapter, count(*) AS n FROM txt GROUP BY chapter) SELECT vec.chapter, vec.idx, vec_id, "
    "CASE WHEN txt.idx IS NULL THEN 'Sentence ' || (vec.idx - coalesce(n, 0)) || ' from Chapter ' || vec.chapter ELSE sentence END AS sentence, "
    "CASE WHEN txt.idx IS NULL THEN 'unknown' ELSE character END AS character, CASE WHEN txt.idx IS NULL THEN 'unknown' ELSE place END AS place "
    "FROM vec LEFT JOIN txt ON txt.chapter = vec.chapter AND txt.idx = vec.idx LEFT JOIN cnt ON cnt.chapter = vec.chapter"
)


def _label(joined: str) -> str:
    return f"CASE WHEN trim({joined}) = '' THEN 'unknown' ELSE trim(split_part({joined}, ',', 1)) END"


def _knn(k: int, distance: str, same_label: bool) -> str:
    where = "WHERE a.label = b.label" if same_label else ""
    return (
        f"WITH {_UNITS}, dist AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(greatest({distance}, 0.0), 6) AS distance FROM u a CROSS JOIN u b {where}) "
        "SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM dist "
        f"QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= {k}"
    )


def _ranks(value: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {value}, sum(n) OVER (ORDER BY {value}) - n + (n + 1) / 2.0 AS r FROM "
        f"(SELECT {value}, count(*) AS n FROM sc GROUP BY {value}))"
    )

# --- hierarchy: one merge at a time, the closest pair of clusters by (distance, names) -----


def _tree(average: str = "avg") -> str:
    """Common tables up to ``st(step, w, c, l, r, h)``: the cluster of every word after each merge,
    and ``mg(step, l, r, h, size)``: the merges."""
    return f"""RECURSIVE {_ASSOC}, {_STRENGTH},
topw AS (SELECT word FROM strength ORDER BY strength DESC, word LIMIT {MAX_WORDS}),
pm AS (SELECT least(word1, word2) AS a, greatest(word1, word2) AS b, min(mi_score) AS mi FROM assoc
       WHERE word1 IN (SELECT word FROM topw) AND word2 IN (SELECT word FROM topw) GROUP BY ALL),
ws AS (SELECT a AS w FROM pm UNION SELECT b FROM pm),
cells AS (SELECT x.w AS a, y.w AS b, coalesce(pm.mi, 0.0) AS mi
          FROM ws x CROSS JOIN ws y LEFT JOIN pm ON pm.a = least(x.w, y.w) AND pm.b = greatest(x.w, y.w)),
span AS (SELECT min(mi) AS low, max(mi) AS high FROM cells),
dm AS (SELECT a, b, 1.0 - CASE WHEN high <= 0 THEN mi WHEN high = low THEN mi - low ELSE (mi - low) / (high - low) END AS d
       FROM cells, span WHERE a < b),
st AS (
  SELECT 0 AS step, w, w AS c, w AS l, w AS r, 0.0::DOUBLE AS h FROM ws
  UNION ALL
  SELECT st.step + 1, st.w, CASE WHEN st.c = m.r THEN m.l ELSE st.c END, m.l, m.r, m.h
  FROM st, (SELECT l, r, h FROM (SELECT least(x.c, y.c) AS l, greatest(x.c, y.c) AS r, round({average}(d), 12) AS h
            FROM st x JOIN dm ON dm.a = x.w JOIN st y ON y.w = dm.b WHERE x.c <> y.c GROUP BY ALL) ORDER BY h, l, r LIMIT 1) m
),
mg AS (SELECT step, l, r, h, sum(CASE WHEN c = l THEN 1 ELSE 0 END) AS size FROM st WHERE step > 0 GROUP BY ALL)"""


def _cut(height: str) -> str:
    """``(word, cluster)`` when all merges up to a height apply."""
    return f"SELECT w AS word, c AS cluster FROM st WHERE step = (SELECT max(step) FROM st WHERE h <= {height} OR step = 0)"


_BY_COUNT = _cut("(SELECT coalesce(max(h), -1) FROM mg WHERE step = (SELECT max(step) FROM mg) - 20 + 1)")
_BY_DISTANCE = _cut("0.7")
_CHILDREN = """kids AS (
  SELECT m.step, m.h, m.size, m.l, m.r,
    (SELECT max(e.step) FROM mg e WHERE e.l = m.l AND e.step < m.step) AS ls,
    (SELECT max(e.step) FROM mg e WHERE e.l = m.r AND e.step < m.step) AS rs
  FROM mg m
)"""
_NODES = f"""{_CHILDREN},
leaf AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS node FROM ws),
many AS (SELECT count(*) AS n FROM ws),
inners AS (
  SELECT n + step - 1 AS node, CAST(NULL AS VARCHAR) AS label, coalesce(n + ls - 1, a.node) AS left_node, coalesce(n + rs - 1, b.node) AS right_node,
    size AS leaves, h AS height
  FROM kids JOIN leaf a ON a.w = kids.l JOIN leaf b ON b.w = kids.r, many
),
nodes AS (SELECT * FROM inners UNION ALL SELECT node, w, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1, 0.0 FROM leaf),
up AS (SELECT left_node AS node, node AS parent FROM inners UNION ALL SELECT right_node, node FROM inners),
deep AS (
  SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT node FROM up)
  UNION ALL
  SELECT up.node, level + 1 FROM deep JOIN up ON up.parent = deep.node
)"""
_LAST = 49

# --- principal components by squaring the covariance matrix, one component after the other ---


def _pca(group: str, k: int, squarings: int = 16) -> str:
    """Tables up to ``pc(vec_id, label, c, val)``: coordinate ``c`` of every vector.

    A symmetric matrix squared again and again keeps its leading eigenvector alone; the rows of
    the square are inner products of rows. What a component explains is then taken out.
    """
    parts = [
        f"""RECURSIVE vec AS (SELECT vec_id, label, {group} AS g, embedding::DOUBLE[] AS e FROM embeddings),
flat AS (SELECT g, vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vec),
means AS (SELECT g, i, avg(x) AS m FROM flat GROUP BY ALL),
centre AS (SELECT g, list(m ORDER BY i) AS m FROM means GROUP BY g),
moment AS (SELECT a.g, a.i, b.i AS j, avg(a.x * b.x) AS v FROM flat a JOIN flat b ON a.g = b.g AND a.vec_id = b.vec_id GROUP BY ALL),
c1 AS (SELECT v.g, v.i, list(v.v - a.m * b.m ORDER BY v.j) AS r FROM moment v JOIN means a ON a.g = v.g AND a.i = v.i
       JOIN means b ON b.g = v.g AND b.i = v.j GROUP BY v.g, v.i)"""
    ]
    for c in range(1, k + 1):
        parts.append(
            f"""s{c} AS (
  SELECT 0 AS step, g, i, r FROM c{c}
  UNION ALL
  SELECT step + 1, g, i, list_transform(r, lambda x: x / t) FROM (
    SELECT step, g, i, r, sum(r[i]) OVER (PARTITION BY g) AS t FROM (
      SELECT a.step, a.g, a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r
      FROM s{c} a JOIN s{c} b ON a.g = b.g GROUP BY a.step, a.g, a.i
    )
  ) WHERE step < {squarings}
), w{c} AS (SELECT g, arg_max(r, r[i]) AS r FROM s{c} WHERE step = {squarings} GROUP BY g),
v{c} AS (
  SELECT g, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) *
    CASE WHEN list_max(r) >= -list_min(r) THEN 1 ELSE -1 END) AS v FROM w{c}
), l{c} AS (SELECT c.g, sum(v[c.i] * list_dot_product(c.r, v)) AS l FROM c{c} c JOIN v{c} ON v{c}.g = c.g GROUP BY c.g)"""
        )
        if c < k:
            parts.append(
                f"c{c + 1} AS (SELECT c.g, c.i, list_transform(list_zip(c.r, v), lambda p: p[1] - l * v[c.i] * p[2]) AS r "
                f"FROM c{c} c JOIN v{c} ON v{c}.g = c.g JOIN l{c} ON l{c}.g = c.g)"
            )
    each = " UNION ALL ".join(
        f"SELECT vec_id, label, {c} AS c, list_dot_product(e, v) - list_dot_product(m, v) AS val "
        f"FROM vec JOIN centre ON centre.g = vec.g JOIN v{c} ON v{c}.g = vec.g"
        for c in range(1, k + 1)
    )
    return ", ".join([*parts, f"pc AS ({each})"])


def _coordinates(names: list[str]) -> str:
    return ", ".join(f"round(max(CASE WHEN c = {k} THEN val END), 6) AS {n}" for k, n in enumerate(names, 1))


# --- fuzzy neighbour graph -----------------------------------------------------------


def _fuzzy_raw(k: int, steps: int = 64) -> str:
    return f"""WITH RECURSIVE nn AS ({_knn(k, "list_distance(a.e, b.e)", False)}),
pts AS (
  SELECT src, list(distance ORDER BY rank) AS d, coalesce(min(CASE WHEN distance > 0 THEN distance END), 0.0) AS rho, avg(distance) AS own
  FROM nn GROUP BY src
), bis AS (
  SELECT src, d[2:{k}] AS d, rho, 0 AS step, 0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1.0::DOUBLE AS mid, false AS done FROM pts
  UNION ALL
  SELECT src, d, rho, step + 1,
    CASE WHEN ok OR w > log2({k}) THEN low ELSE mid END,
    CASE WHEN NOT ok AND w > log2({k}) THEN mid ELSE high END,
    CASE WHEN ok THEN mid WHEN w > log2({k}) THEN (low + mid) / 2 WHEN high = 'inf'::DOUBLE THEN mid * 2 ELSE (mid + high) / 2 END,
    ok
  FROM (
    SELECT *, done OR abs(w - log2({k})) < 1e-5 AS ok FROM (
      SELECT *, list_sum(list_transform(d, lambda x: CASE WHEN x > rho THEN exp(-(x - rho) / mid) ELSE 1.0 END)) AS w FROM bis WHERE step < {steps}
    )
  )
), scaled AS (
  SELECT pts.src, pts.rho, greatest(bis.mid, 0.001 * CASE WHEN pts.rho > 0 THEN own ELSE (SELECT avg(distance) FROM nn) END) AS sigma
  FROM pts JOIN bis ON bis.src = pts.src AND bis.step = {steps}
), arrow AS (
  SELECT nn.src, nn.dst, CASE WHEN distance <= rho OR sigma = 0 THEN 1.0 ELSE exp(-(distance - rho) / sigma) END AS w
  FROM nn JOIN scaled ON scaled.src = nn.src WHERE nn.src <> nn.dst
), both_ways AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, coalesce(max(CASE WHEN src < dst THEN w END), 0.0) AS f,
    coalesce(max(CASE WHEN src > dst THEN w END), 0.0) AS r FROM arrow GROUP BY ALL
)
SELECT a AS src, b AS dst, f, r FROM both_ways WHERE f + r - f * r > 0"""


def statements() -> dict[str, str]:
    """Query name to SQL."""
    by_language = " ".join(
        f"WHEN '{code}' THEN {_kept('w', _quoted(stop_words(LANGUAGE_OF_CODE[code])))}" for code in ("en", "fr", "de", "es")
    )
    term_frequency = (
        f"WITH {_TOKENS}, {_STREAM} SELECT word, count(*) AS frequency FROM flat GROUP BY word"
    )
    pmi = "SELECT word1, word2, n_pair, round(mi_score, 6) AS mi_score FROM assoc"
    sql = {
        "clean_text": f"SELECT doc_id, {_cleaned('text')} AS cleaned FROM documents",
        "tokens_by_lang": (
            f"WITH w AS (SELECT doc_id, lang, {_words(_cleaned('text'))} AS w FROM documents) "
            f"SELECT doc_id, array_to_string(CASE lang {by_language} ELSE w END, ' ') AS tokens FROM w"
        ),
        "search_tokens": f"SELECT doc_id, array_to_string({_search_tokens('text')}, ' ') AS tokens FROM documents",
        "term_frequency": term_frequency,
        "term_frequency_top": f"{term_frequency} ORDER BY frequency DESC, word LIMIT 10",
        "split_sentences": f"WITH {_SENTENCE_ROWS} SELECT doc_id, sentence_id, sentence FROM sents",
        "naive_sentences": (
            f"WITH arrs AS (SELECT doc_id, {_naive('text')} AS s FROM documents) "
            "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_id FROM arrs"
        ),
        "processed_sentences": (
            f"WITH {_SENTENCE_ROWS} SELECT doc_id, sentence_id, {_cleaned('sentence')} AS cleaned_sentence, "
            f"array_to_string({_kept(_words(_cleaned('sentence')))}, ' ') AS tokens FROM sents"
        ),
        "sentence_counts": f"WITH {_SENTENCE_ROWS} SELECT source, count(*) AS n_sentences FROM sents GROUP BY source",
        "split_chapters": _chapters("Chapter \\d"),
        "split_chapters_long": _chapters("Chapter \\d+"),
        "cooccurrence_doc": f"WITH {_PAIRS_DOC} SELECT * FROM pairs",
        "cooccurrence_sentence": (
            f"WITH {_SENTENCE_ROWS}, toks AS (SELECT doc_id, sentence_id, {_kept(_words(_cleaned('sentence')))} AS tokens FROM sents), "
            "flat AS (SELECT doc_id, sentence_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks) "
            "SELECT a.word AS word1, b.word AS word2, count(*) AS n_pair FROM flat a JOIN flat b ON a.doc_id = b.doc_id "
            "AND a.sentence_id = b.sentence_id AND b.pos - a.pos BETWEEN 1 AND 9 GROUP BY ALL HAVING count(*) >= 10"
        ),
        "cooccurrence_corpus": f"WITH {_PAIRS_CORPUS} SELECT * FROM pairs",
        "pmi_doc": f"WITH {_ASSOC} {pmi}",
        "pmi_corpus": f"WITH {_scored(_PAIRS_CORPUS)} {pmi}",
        "pmi_top": f"WITH {_scored(_PAIRS_CORPUS)} {pmi} ORDER BY assoc.mi_score DESC, word1, word2 LIMIT 10",
        "association_measure": (
            f"WITH {_scored(_PAIRS_DOC, 'n_pair / 9.0 * n / (a.frequency::DOUBLE * b.frequency)')} {pmi}"
        ),
        "row_ids": "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id FROM documents",
        "mention_tags": (
            f"WITH {_TAGGED} SELECT doc_id, sentence_id, array_to_string(c, ', ') AS character, array_to_string(p, ', ') AS place FROM tagged"
        ),
        "mention_filter": (
            f"WITH {_TAGGED} SELECT doc_id, sentence_id, sentence, array_to_string(c, ', ') AS character, array_to_string(p, ', ') AS place "
            "FROM tagged WHERE len(c) + len(p) > 0"
        ),
        "factorize_label": (
            f"WITH t AS (SELECT doc_id, ({_mentions('lower(text)', LEXICON_CHARACTERS)})[1] AS character FROM documents), "
            "f AS (SELECT character, min(doc_id) AS seen FROM t WHERE character IS NOT NULL GROUP BY character), "
            "c AS (SELECT character, row_number() OVER (ORDER BY seen, character) - 1 AS character_label FROM f) "
            "SELECT doc_id, character, character_label FROM t JOIN c USING (character)"
        ),
        "hover_labels": (
            f"WITH {_TAGGED} SELECT doc_id, sentence_id, coalesce(c[1], 'unknown') AS character_label, coalesce(p[1], 'unknown') AS place_label, "
            "CASE WHEN length(sentence) > 100 THEN left(sentence, 100) || '...' ELSE sentence END AS hover_text FROM tagged"
        ),
        "vocabulary": f"WITH {_ASSOC} SELECT word1 AS word FROM assoc UNION SELECT word2 FROM assoc",
        "word_strength": f"WITH {_ASSOC}, {_STRENGTH} SELECT word, strength FROM strength",
        "prune_network": (
            f"WITH {_ASSOC}, {_STRENGTH}, top AS (SELECT word FROM strength ORDER BY strength DESC, word LIMIT {MAX_WORDS}) "
            "SELECT word1, word2, round(mi_score, 6) AS mi_score FROM assoc WHERE word1 IN (SELECT word FROM top) AND word2 IN (SELECT word FROM top)"
        ),
        "association_matrix": f"WITH {_MATRIX} SELECT a, b, round(mi, 6) AS mi FROM mat",
        "distance_pairs": f"WITH {_MATRIX} SELECT a, b, round({_scale('mi')}, 6) AS distance FROM mat, lim WHERE a < b",
        "absent_distance": f"WITH {_MATRIX} SELECT n_words, round({_scale('0.0')}, 6) AS absent FROM lim",
        "linkage_merges": f'WITH {_tree()} SELECT step, l AS "left", r AS "right", round(h, 6) AS height, size FROM mg',
        "linkage_single": f'WITH {_tree("min")} SELECT l AS "left", r AS "right", round(h, 6) AS height, size FROM mg',
        "linkage_complete": f'WITH {_tree("max")} SELECT l AS "left", r AS "right", round(h, 6) AS height, size FROM mg',
        "clusters_by_distance": f"WITH {_tree()} {_BY_DISTANCE}",
        "clusters_by_count": f"WITH {_tree()} {_BY_COUNT}",
        "clusters_by_threshold": f"WITH {_tree()} {_cut('(SELECT max(h) FROM mg WHERE step = (SELECT max(step) FROM mg) - 6 + 1)')}",
        "cluster_sizes": f"WITH {_tree()}, cl AS ({_BY_COUNT}) SELECT cluster, count(*) AS size FROM cl GROUP BY cluster",
        "cluster_count": f"WITH {_tree()}, cl AS ({_BY_DISTANCE}) SELECT count(DISTINCT cluster) AS n_clusters FROM cl",
        "cluster_sample": (
            f"WITH {_tree()}, cl AS ({_BY_COUNT}), sized AS (SELECT word, cluster, count(*) OVER (PARTITION BY cluster) AS size, "
            "count(*) OVER () AS n, row_number() OVER (PARTITION BY cluster ORDER BY word) AS rank FROM cl) "
            "SELECT cluster, word, rank, size FROM sized WHERE rank <= CASE WHEN n <= 50 THEN size ELSE greatest(round_even(50.0 * size / n, 0), 1) END"
        ),
        "tree_nodes": (
            f"WITH {_tree()}, {_NODES} SELECT nodes.node, label, parent, left_node, right_node, leaves, 2 * leaves - 1 AS subtree, "
            "round(height, 6) AS height, level FROM nodes JOIN deep ON deep.node = nodes.node LEFT JOIN up ON up.node = nodes.node"
        ),
        "truncated_tree": (
            f"WITH {_tree()}, {_CHILDREN}, shown AS (SELECT * FROM kids WHERE step > (SELECT max(step) FROM mg) - {_LAST}), "
            "ends AS (SELECT l AS cluster, ls AS s FROM shown UNION ALL SELECT r, rs FROM shown) "
            "SELECT cluster, coalesce(mg.size, 1) AS leaves FROM ends LEFT JOIN mg ON mg.step = s "
            "WHERE s IS NULL OR s NOT IN (SELECT step FROM shown)"
        ),
        "exact_match": f"WITH {_EXACT} SELECT query_id, doc_id, 'accurate' AS match_type FROM hits",
        "keyword_positions": (
            f"WITH {_EXACT}, k AS (SELECT query_id, doc_id, text, unnest(list_distinct(keywords)) AS keyword FROM hits) "
            "SELECT query_id, doc_id, keyword, strpos(lower(text), lower(keyword)) - 1 AS position FROM k"
        ),
        "bm25_stats": (
            f"WITH said AS (SELECT unnest(list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: trim(t, '{_PUNCT}')))) AS word FROM documents), "
            f"freq AS (SELECT word, count(*) AS df FROM said WHERE word <> '' AND word NOT IN ({_STOP}) GROUP BY word), "
            "raw AS (SELECT word, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM freq, (SELECT count(*) AS n FROM documents)), "
            "usual AS (SELECT avg(r) AS m FROM raw) "
            "SELECT word, df, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 6) AS idf FROM raw, usual"
        ),
        "bm25_topk": (
            f"WITH {_BM25_TOP} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM allsc "
            "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"
        ),
        "bm25_indexed": (
            f"WITH {_BM25_TOP} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc "
            "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"
        ),
        "first_documents": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
        "parse_embedding": "SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
        "cosine_pairs": (
            f"WITH {_UNITS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b "
            "ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.3"
        ),
        "centrality": f"WITH {_CENTRAL} SELECT label, vec_id, round(s, 6) AS avg_similarity FROM sc",
        "central_extremes": (
            f"WITH {_CENTRAL}, r AS (SELECT label, vec_id, round(s, 6) AS s FROM sc) SELECT label, "
            "arg_max(vec_id, (s, -vec_id)) AS most_similar_id, max(s) AS most_similar_score, "
            "arg_min(vec_id, (s, vec_id)) AS least_similar_id, min(s) AS least_similar_score FROM r GROUP BY label"
        ),
        "semantic_topk": (
            f"WITH {_FIRST_CENTER}, s AS (SELECT query_id, vec_id, round(list_dot_product(c, v) / sqrt(list_dot_product(c, c)), 6) AS similarity FROM ctr, u), "
            "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) "
            "SELECT * FROM t WHERE rank <= 5 AND similarity >= 0.35"
        ),
        "retrieve_priority": (
            f"WITH {_EXACT}, rest AS (SELECT query_id, keywords FROM queries WHERE query_id NOT IN (SELECT query_id FROM hits)), "
            + _vector_hits("SELECT query_id, array_to_string(keywords, ' ') AS qtext FROM rest", 5)
            + " SELECT query_id, doc_id, 'accurate' AS match_type, NULL::DOUBLE AS similarity, NULL AS keywords_contained, keywords[1] AS first_keyword FROM hits "
            "UNION ALL SELECT query_id, doc_id, 'semantic', score, array_to_string(list_filter(keywords, lambda k: contains(lower(text), lower(k))), '|'), NULL "
            "FROM vhits JOIN rest USING (query_id) WHERE score >= 0.5"
        ),
        "rerank_topk": (
            f"WITH {_RERANKED} SELECT query_id, doc_id, score, cross_score, rank, CASE WHEN length(text) > 100 THEN left(replace(text, chr(10), ' '), 100) || '...' "
            "ELSE replace(text, chr(10), ' ') END AS passage FROM best"
        ),
        "search_report": (
            f"WITH {_BM25_TOP}, {_RERANKED}, lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM allsc) "
            "SELECT 'lexical' AS stage, query_id, doc_id, score, rank FROM lex WHERE rank <= 3 "
            "UNION ALL SELECT 'vector', query_id, doc_id, score, rank FROM vhits WHERE rank <= 3 "
            "UNION ALL SELECT 'reranked', query_id, doc_id, cross_score, rank FROM best"
        ),
        "training_pairs": f"WITH {_TRAINING} SELECT * FROM tp",
        "pair_split": (
            f"WITH {_TRAINING} SELECT doc_id, i, kind, label, CASE WHEN row_number() OVER (ORDER BY doc_id, i, kind) <= least(500, count(*) OVER () // 10) "
            "THEN 'eval' ELSE 'train' END AS split FROM tp"
        ),
        "encoder_eval": (
            f"WITH {_TRAINING}, low AS (SELECT label, lower(text_a) AS ta, lower(text_b) AS tb FROM tp), "
            f"enc AS (SELECT label, {_profile('ta')} AS va, {_profile('tb')} AS vb FROM low), "
            f"sc AS (SELECT label, round({_cos('va', 'vb')}, 6) AS cos FROM enc), {_ranks('cos', 'rc')}, {_ranks('label', 'rl')} "
            "SELECT count(*) AS n_pairs, round(corr(sc.cos, sc.label), 6) AS pearson, round(corr(rc.r, rl.r), 6) AS spearman "
            "FROM sc JOIN rc ON rc.cos = sc.cos JOIN rl ON rl.label = sc.label"
        ),
        "knn_graph": _knn(50, "1.0 - round(list_dot_product(a.v, b.v), 6)", False),
        "knn_graph_grouped": _knn(20, "list_distance(a.e, b.e)", True),
        "fuzzy_graph": f"SELECT src, dst, round(f + r - f * r, 6) AS weight FROM ({_fuzzy_raw(20)})",
        "layout_2d": f"WITH {_pca('0', 2)} SELECT vec_id, {_coordinates(['x', 'y'])} FROM pc GROUP BY vec_id",
        "layout_3d": f"WITH {_pca('0', 3)} SELECT vec_id, {_coordinates(['x', 'y', 'z'])} FROM pc GROUP BY vec_id",
        "pca_project": f"WITH {_pca('label', 8)} SELECT vec_id, label, {_coordinates([f'pc{i}' for i in range(1, 9)])} FROM pc GROUP BY vec_id, label",
        "align_pad": _ALIGNED,
        "edge_table": (
            f"WITH k AS ({_knn(50, '1.0 - round(list_dot_product(a.v, b.v), 6)', False)}) "
            "SELECT src, dst, round(a.embedding[1]::DOUBLE, 6) AS x0, round(a.embedding[2]::DOUBLE, 6) AS y0, "
            "round(b.embedding[1]::DOUBLE, 6) AS x1, round(b.embedding[2]::DOUBLE, 6) AS y1, round(1 - distance, 6) AS weight "
            "FROM k JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst"
        ),
        "point_table": (
            f"WITH al AS ({_ALIGNED}) SELECT al.*, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, "
            f"{_label('character')} AS character_label, {_label('place')} AS place_label, "
            "CASE WHEN length(sentence) > 100 THEN left(sentence, 100) || '...' ELSE sentence END AS hover_text "
            "FROM al JOIN embeddings USING (vec_id)"
        ),
        "embed_text": f"WITH {_TOKENS} SELECT doc_id, 32 AS dim, len(tokens) > 0 AS has_words, true AS finite FROM toks",
        "length_mismatch": (
            f"WITH {_CHAPTERED}, a AS (SELECT chapter, count(*) AS n FROM vec GROUP BY chapter), b AS (SELECT chapter, count(*) AS n FROM txt GROUP BY chapter) "
            "SELECT coalesce(a.chapter, b.chapter) AS chapter, coalesce(a.n, 0) AS n_vectors, coalesce(b.n, 0) AS n_texts FROM a FULL JOIN b ON a.chapter = b.chapter "
            "WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"
        ),
        "embed_profile": (
            f"SELECT doc_id, array_to_string(list_transform({_profile('lt')}, lambda x: x::BIGINT), ' ') AS profile "
            "FROM (SELECT doc_id, lower(text) AS lt FROM documents)"
        ),
        "io_chapter_csv": (
            f"WITH {_SENTENCE_ROWS} SELECT (doc_id % 20)::INT AS chapter_no, count(*) AS n_sentences, sum(length(sentence)) AS n_chars, "
            f"sum(len({_kept(_words(_cleaned('sentence')))})) AS n_tokens FROM sents GROUP BY 1"
        ),
        "io_association_csv": f"WITH {_ASSOC} SELECT word1, word2, round(mi_score, 6) AS mi_score FROM assoc",
        "io_jsonl_gz": "SELECT string_split(text, chr(10))[1] AS text FROM documents",
        "io_books": (
            "SELECT source, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) AS n_words FROM documents GROUP BY source"
        ),
        "io_embeddings": (
            "SELECT label AS chapter_no, count(*) AS n_vectors, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY label"
        ),
        "io_corpus": "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL",
    }
    sql["io_similarity"] = sql["central_extremes"]
    sql["io_similarity_pairs"] = sql["cosine_pairs"]
    sql["io_similarity_averages"] = sql["centrality"]
    sql["embed_profile_batch"] = sql["embed_profile"]
    sql["bad_vectors"] = "SELECT count(*) FILTER (WHERE vec_id % 7 = 0) AS n_bad FROM embeddings"
    sql["training_sample"] = f"{sql['training_pairs']} ORDER BY doc_id, i, kind LIMIT 500"
    return sql
