"""Pages whose text was cut: drawings without an end, names of asides around the article, split articles."""

from corpusloom.llm.page_templates import extract, main_text


def texts_of(spark, page, n=20):
    rows = [(i, "http://one.example.org/", page(i)) for i in range(n)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_drawings_hide_no_text():
    assert main_text("<p>a</p><svg width='1'/><p>b</p>", "") == "a b"
    assert main_text("<p>a</p><svg/><p>b</p><svg><text>x</text></svg><p>c</p>", "") == "a b c"
    assert main_text("<p>a</p><svg><path><p>b</p><svg><text>x</text></svg><p>c</p>", "") == "a b c"
    assert main_text("<p>a</p><p><svg><text>x</text><foreignObject><div>y</div></foreignObject></svg>b</p>", "") == "a b"
    assert main_text("<p>a</p><iframe src=x><p>b</p><select><option>x</select><p>c</p>", "") == "a b c"
    assert main_text("<p>a</p><object>x<object>y</object>z</object><p>b</p>", "") == "a b"
    assert main_text("<p>a</p><svg><!-- </svg> --><text>x</text></svg><p>b</p>", "") == "a b"


def test_names_around_the_article(spark):
    bar = '<div class="menu">Home {0} More</div><div class="sidebar">Popular {0}</div><div class="footer">Imprint</div>'
    for wrap in ('<div class="content-sidebar-wrap">', '<div id="page" class="site no-sidebar">', '<div class="legal-news">'):
        got = texts_of(spark, lambda i, w=wrap: f"<body>{w}<div class=text><p>Article {i} of many words.<p>And more {i}</div></div>{bar.format(i)}</body>")
        assert got == {i: f"Article {i} of many words. And more {i}" for i in range(20)}, wrap
    for head in ('<header class="entry-header">{}</header>', '<div class="post-header">{}</div>'):
        for box in ("article", "div"):
            got = texts_of(spark, lambda i, h=head, b=box: f"<body><{b} class=post>{h.format(f'<h1>Title {i}</h1>')}Words of the text {i}, quite a few."
                           f"<div class=share>Share</div></{b}>{bar.format(i)}</body>")
            assert got == {i: f"Title {i} Words of the text {i}, quite a few." for i in range(20)}, (head, box)
    comments = '<section id="comments"><p>A long remark by reader {0}, with nothing to say, but saying it.</p></section>'
    got = texts_of(spark, lambda i: f"<body><div class=text>Article {i} has a short text here.</div>{comments.format(i)}</body>")
    assert got == {i: f"Article {i} has a short text here." for i in range(20)}
    assert main_text('<div class="sidebar">all there is</div>', "") == "all there is"


def test_split_articles_stay_whole(spark):
    bar = "<div class=top>The site</div><div class=wrap>{}</div><div class=foot>Number {}</div>"
    posts = {
        "<div class=post><h1>Title {0}</h1><p class=lead>Lead {0}</p><div class=entry><p>Long text of article {0}.</p></div></div>":
            "Title {0} Lead {0} Long text of article {0}.",
        "<div class=post><div class=one>First {0}</div><div class=two>And the second part {0}</div><div class=three>Third {0}</div></div>":
            "First {0} And the second part {0} Third {0}",
        "<div class=post><h1>Title {0}</h1><p>The only paragraph {0}.</p></div>": "Title {0} The only paragraph {0}.",
    }
    for post, want in posts.items():
        got = texts_of(spark, lambda i, p=post: f"<body>{bar.format(p.format(i), i)}</body>")
        assert got == {i: want.format(i) for i in range(20)}, post
