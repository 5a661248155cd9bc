"""Main text of web pages by templates deduced from equivalence classes of tag tokens.

A token is an opening or closing tag with its path of tags and classes. Tokens that occur
equally often on every page of a host (the same occurrence vector, compared by an XOR of page
hashes, which sums in one aggregate) form an equivalence class. Valid classes hold several
tokens that stand once on most pages; nested by their paths they are the host's template. The
text between template tokens fills its slots: the slot with most text over all pages of the
host is the main one, and the article is the container of it and of the slots beside it whose
text differs between pages. Hosts of few pages are pooled.
Only counts are shuffled; a page moves only if the templates are too many to send.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, materialize_counted

#: Fewest pages of a host with a template of its own; share of pages a valid class stands on.
FEW_PAGES, SUPPORT = 3, 0.5
#: Templates sent to all tasks (about 200 bytes each); beyond, pages are joined by host.
SENT_HOSTS = 200_000
PATH_DEPTH = 32

# Tags by the part they play.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var".split()
)
RAW = set("script style textarea title noscript template iframe svg math object select".split())
ASIDE = set("nav footer aside form button dialog menu head".split()) | RAW
#: Weight of a character, against one in an element whose name speaks against main text.
PLAIN = 8
# Words of class and id attributes that name what is no main text, unless it holds
# the fullest slot; HEADS hold the page's title or the article's.
HEADS = {"header", "masthead"}
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus "
    "respond reply replies login signup widget toolbar pagination pager copyright legal disclaimer".split()
)

_TAG = re.compile(
    r"<!--.*?(?:--\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_SKIPPED = set("noscript template iframe svg math object select".split())
_DRAWN = ("svg", "math")
# what opens and closes skipped elements, and the tags of text that end an open drawing
_SKIP = re.compile(
    r"<!--.*?(?:--\s*>|\Z)|<(script|style|textarea|title)\b.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)(noscript|template|iframe|svg|math|object|select|foreignobject|p|div|h[1-6]|ul|ol|dl|table|blockquote|pre)\b"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_HEADING = re.compile(r"/h[12]\b")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Element:
    tag: str
    path: str  # of the element and all around it, to PATH_DEPTH
    aside: bool  # it or an element around it is no main text
    named: tuple[str, ...]  # paths of it and those around it whose names speak against main text
    headed: bool  # it or an element around it is a page header, unless the main text is around that


@dataclass
class Page:
    tokens: dict[str, int] = field(default_factory=dict)  # tag tokens and how often
    mass: dict[str, int] = field(default_factory=dict)  # weighted characters straight inside each path
    said: dict[str, int] = field(default_factory=dict)  # hash of the plain text straight inside each path
    blocks: list[tuple[Element, str]] = field(default_factory=list)  # innermost element, text


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Name of an element in paths, and whether its attributes call it an aside or a header."""
    if not attributes or attributes.isspace():
        return tag, False, False
    said = []
    for m in _NAMES.finditer(attributes):
        said += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower())
    said = [w for w in said if w]
    name = tag + "".join("." + re.sub("[0-9]+", "#", w) for w in said[:4])
    free = tag in ("html", "body", "article", "main")
    return name, not free and any(w in ASIDE_NAMES for w in said), not free and any(w in HEADS for w in said)


def _ends(source: str) -> dict[int, int]:
    """Start of each skipped element that is closed, and where it ends; the others are not in it."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for m in _SKIP.finditer(source):
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in _SKIPPED and tag != "foreignobject":
            if not m[2] and not opened.get("foreignobject"):
                for drawn in _DRAWN:
                    opened.pop(drawn, None)
        elif m[2]:
            if opened.get(tag):
                ends[opened[tag].pop()] = m.end()
        elif not (tag in _DRAWN and m[4].rstrip().endswith("/")):
            opened.setdefault(tag, []).append(m.start())
    return ends


def read_page(source: str) -> Page:
    """Tag tokens and text blocks of a page, however broken its markup is."""
    page = Page()
    stack = [Element("", "", False, (), False)]
    parts: list[str] = []
    at, n = 0, len(source)
    ends: dict[int, int] | None = None

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                page.blocks.append((top, text))
                if not top.aside:
                    weight = 1 if top.named or top.headed else PLAIN
                    if weight == PLAIN:
                        page.said[top.path] = zlib.crc32(text.encode("utf-8", "replace"), page.said.get(top.path, 0))
                    page.mass[top.path] = page.mass.get(top.path, 0) + weight * len(text)

    def count(token: str) -> None:
        page.tokens[token] = page.tokens.get(token, 0) + 1

    while at < n:
        m = _TAG.search(source, at)
        if not m:
            parts.append(source[at:])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if tag in INLINE:
            continue
        close_block()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    count("/" + stack[k].path)
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        name, aside, header = _named(tag, m[3] or "")
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            stack.pop()  # such an element ends where the next begins
        elif stack[-1].tag == "p":
            stack.pop()
        around = stack[-1]
        # a header inside an article holds its title; elsewhere it is the page's
        header = (header or tag == "header") and not re.search(r"/(article|main)\b", around.path)
        path = around.path + "/" + name if around.path.count("/") < PATH_DEPTH else around.path
        count(path)
        if tag in _SKIPPED:
            # one that is never closed is empty: the text after it stays
            if ends is None:
                ends = _ends(source)
            at = ends.get(m.start(), at)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        named = (*around.named, path) if aside and path != around.path else around.named
        if tag == "main":  # a page has one, and says so itself
            named = ()
        stack.append(Element(tag, path, around.aside or tag in ASIDE, named, tag != "main" and (around.headed or header)))
    close_block()
    return page


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null and odd ones share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _token_counts(pages: DataFrame) -> DataFrame:
    """host, token, vector, pages, total, mass, low, high: counts of one run of pages; token '' is the page.

    ``low`` and ``high`` are the least and the greatest hash of a page's plain text in a path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page_no = TaskContext.get().partitionId() << 36
        for b in batches:
            sums: dict[tuple[str, str], list[int | None]] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page_no += 1
                page = read_page(source)
                for token, k in [("", 1), *page.tokens.items()]:
                    s = sums.setdefault((host, token), [0, 0, 0, 0, None, None])
                    s[0] ^= _scrambled(page_no * 1000003 + k)
                    s[1] += 1
                    s[2] += k
                for path, chars in page.mass.items():
                    if (host, path) in sums:
                        sums[(host, path)][3] += chars
                    else:  # the root
                        sums[(host, "")][3] += chars
                for path, said in page.said.items():
                    s = sums[(host, path if (host, path) in sums else "")]
                    s[4] = said if s[4] is None else min(s[4], said)
                    s[5] = said if s[5] is None else max(s[5], said)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in sums], pa.string()),
                    pa.array([t for _, t in sums], pa.string()),
                    *[pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(6)],
                ],
                ["host", "token", "vector", "pages", "total", "mass", "low", "high"],
            )

    return pages.select("host", "html").mapInArrow(
        run, "host string, token string, vector bigint, pages bigint, total bigint, mass bigint, low bigint, high bigint"
    )


def _scrambled(x: int) -> int:
    """64-bit hash of a number, as a signed integer."""
    x = (x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _merged(counts: DataFrame, host: str) -> DataFrame:
    return counts.groupBy(F.col(host).alias("host"), "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"),
        F.sum("total").alias("total"), F.sum("mass").alias("mass"), F.min("low").alias("low"), F.max("high").alias("high"),
    )


def deduce(counts: DataFrame, few: int = FEW_PAGES, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Templates from token counts: (host, pool) and (pool, main).

    ``main`` is the path of the container of the main slot, '' if the pool has no template.
    """
    by_host = materialize(_merged(counts, "host"))
    sizes = by_host.where(F.col("token") == "").select("host", F.col("pages").alias("host_pages"))
    pools = materialize(
        sizes.select("host", F.when(F.col("host_pages") >= few, F.col("host")).otherwise("").alias("pool"))
    )
    tokens = materialize(_merged(by_host.join(pools, "host"), "pool").withColumnRenamed("host", "pool"))
    whole = tokens.where(F.col("token") == "").select("pool", F.col("pages").alias("all"))
    tags = tokens.where(F.col("token") != "").join(whole, "pool")
    once = tags.where((F.col("total") == F.col("pages")) & (F.col("pages") >= support * F.col("all")))
    # equivalence classes: same pool, same vector; valid with two tokens or more
    valid = once.groupBy("pool", "vector", "pages").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    template = once.where(~F.col("token").startswith("//")).join(
        valid.select("pool", "vector", "pages"), ["pool", "vector", "pages"], "left_semi"
    ).select("pool", F.col("token").alias("element"), F.lit(True).alias("valid"))
    # text of a path fills the slot of the deepest template element around it
    steps = F.split("token", "/")
    around = F.transform(
        F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")
    )
    texts = tags.where((F.col("mass") > 0) & ~F.col("token").startswith("//")).select(
        "pool", "token", "mass", F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("differs"),
        F.explode(around).alias("element"),
    )
    slots = (
        texts.join(template, ["pool", "element"])
        .groupBy("pool", "token", "mass", "differs").agg(F.max_by("element", F.length("element")).alias("element"))
        .groupBy("pool", "element").agg(F.sum("mass").alias("mass"), F.max("differs").alias("differs"))
    )
    # as many as a page has once-only elements
    elements = (
        template.select("pool", "element").distinct().join(slots, ["pool", "element"], "left")
        .groupBy("pool").agg(F.collect_list(F.struct("element", "mass", "differs")).alias("elements"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mains = [
                container([(e["element"], e["mass"] or 0, bool(e["differs"])) for e in x]) for x in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mains, pa.string())], ["pool", "main"])

    return pools, elements.select("pool", "elements").mapInArrow(run, "pool string, main string")


def container(elements: list[tuple[str, int, bool]]) -> str:
    """Path of the main container from template elements: path, mass of the slot, whether its text differs.

    The fullest slot, and around it as long as the next element holds more slots whose text
    differs between pages. A slot alone without a heading looks through elements that hold nothing else.
    An article or main element around the slot is the container.
    """
    mass, main = max((mass, path) for path, mass, _ in elements)
    if not mass:
        return ""
    if wide := re.match(r".*?/(?:article|main)(?:\.[^/]*)?(?=/|$)", main):
        return wide[0]
    joined = False
    live = [path + "/" for path, _, differs in elements if differs]
    for up in sorted((path for path, _, _ in elements if main.startswith(path + "/")), key=len, reverse=True):
        if any(path.startswith(up + "/") and not path.startswith(main + "/") for path in live):
            main, joined = up, True
        elif (
            joined
            or any(path.startswith(main + "/") and _HEADING.search(path[len(main) :]) for path in live)
            or any(path.startswith(up + "/") and not f"{path}/".startswith(main + "/") and not main.startswith(path + "/") for path, _, _ in elements)
        ):
            break
    return main


def main_text(source: str, main: str) -> str:
    """Blocks inside the main container in page order, or of the whole page if it has none."""
    blocks = [(e, t) for e, t in read_page(source).blocks if not e.aside]
    below = main + "/"
    inside = [
        t for e, t in blocks
        if (e.path == main or e.path.startswith(below)) and not any(p.startswith(below) for p in e.named)
    ] if main else []
    return " ".join(inside or [t for e, t in blocks if not e.named and not e.headed] or [t for _, t in blocks])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null page is empty and has no text; a null or odd URL belongs to the empty host; a host of
    fewer than ``FEW_PAGES`` pages shares the pooled template; a page without the template's
    container gives all text that is no aside. Repeated rows are read each; an empty table gives
    no rows. Other columns are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()
    read = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        F.coalesce(F.col(source), F.lit("")).alias("html"),
    )
    pools, mains = deduce(_token_counts(read))
    known, n = materialize_counted(
        pools.join(mains, "pool", "left").select("host", F.coalesce("main", F.lit("")).alias("main"))
    )
    placed = read.join(F.broadcast(known) if n <= SENT_HOSTS else known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s, m) for s, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return placed.select("page_id", "url", "html", F.coalesce("main", F.lit("")).alias("main")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint"
    )
