import html
import random
import re

from corpusloom.llm.page_templates import extract, main_text, read_page
from corpusloom.llm.queries import op2_page_text

SF = "/root/testdata/sf0.01"


def article(source):
    """Text of the article element by plain cutting; enough for the given pages."""
    body = re.search(r"(?s)<article[^>]*>(.*?)(</article>|<footer|\Z)", source)[1]
    blocks = re.split(r"(?i)</?(?!/?b\b|/?a\b|/?i\b)[a-z][^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_page_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == article(pages[r.page_id].html), r.page_id


SHELL = """<!DOCTYPE html><html><head><title>t</title></head><body class="home"><header><a href="/">Site</a></header>
<div class="cookie-notice">We use cookies</div><div class="menu"><ul><li>One<li>Two</ul></div>
<div class="wrap"><div class="content" id="post-{n}">{text}</div><div class="sidebar">Popular {n}</div></div>
<section id="comments"><p>First! {n}</p></section><form><input value="x">Search</form><script>if (a<b) "</p>"</script>
<div class="footer">Imprint</div></body></html>"""


def test_other_layout(spark):
    rng = random.Random(1)
    want, rows = {}, []
    for i in range(40):
        words = [" ".join(rng.choice(["alpha", "beta", "x &amp; y", "&eacute;t&#233;"]) for _ in range(rng.randint(5, 40))) for _ in range(3)]
        text = f"<h1>{words[0]}</h1><p>{words[1]}<br>more\n  <b>bo</b>ld<p>{words[2]}" + "<div class='ad-slot'>Buy</div>" * (i % 2)
        rows.append((i, f"https://user@Shop.example.com:80/p/{i}", SHELL.replace("{n}", str(i)).replace("{text}", text), 1))
        want[i] = " ".join([html.unescape(words[0]), html.unescape(words[1]), "more bold", html.unescape(words[2])])
    rows += [(100, None, None, 1), (101, "not a url", "", 1), (None, None, "plain text &lt;b&gt; only", 1), (None, None, "plain text &lt;b&gt; only", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int").repartition(3)
    got = extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            assert r.text == "plain text <b> only"
        else:
            assert r.text == want.get(r.page_id, ""), r.page_id


def test_broken_markup():
    for source in ["<", "<p", "a<b>c", "<p><p><div></p></p>x", "<script>", "<!--", "<![CDATA[a<b]]>", "<a href='x", "</div></div>", "<p>" * 500 + "deep",
                   "<div>" * 3000 + "deep" + "</div>" * 10]:
        read_page(source)
    assert main_text("<div>" * 3000 + "deep", "") == "deep"
    assert main_text("<p>a &lt; b</p><![CDATA[c<d]]>", "") == "a < b c<d"
    assert main_text("x<style>y</style><textarea>z</textarea>w", "") == "x w"


def test_copies_of_one_page_keep_their_text(spark):
    page = SHELL.replace("{n}", "7").replace("{text}", "<p>The one article.</p>")
    rows = [(i, "http://copies.example.org/", page) for i in range(30)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got] == ["The one article."] * 30


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
