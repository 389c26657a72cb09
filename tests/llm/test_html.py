import html as entities
import re
import time

import pytest

from loomsheet.llm import html
from loomsheet.llm.queries_html import op1_html


def text_of(page, path=None):
    stream = html.read(page)
    return html.extract(stream, stream[1].find(path) if path else html.best(html.scores(stream)))


def test_query_equals_a_plain_reading_of_these_templates(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op1_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.sub(r"<!--.*?-->|<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", "\0", body), flags=re.S).split("\0")
        want = "\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)
        assert r["text"] == want and r["n_chars"] == len(want)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page-7"><header><a href=/>Home</a></header>
<div class="cookie-notice">We use cookies, please accept all of them now.</div><nav><ul><li><a href="/a">A</a></ul></nav>
<div id=main class="col-8 content"><h1>Title &amp; more</h1><p>First <b>bold
 text</b> here &lt;ok&gt;&nbsp;x<p>Second one, unclosed<div class="ad-slot">Buy!</div><script>var x = "</p><p>no";</script><ul><li>one<li>two</ul>
<form><input><p>Search</p></form><blockquote>said</blockquote><section class="comments"><p>A reader's very long comment that has many words in it, more than all others on this page, and still it isn't the article.</p></section></div>
<aside>Side bar text</aside><div class="sidebar"><p>Other things to read</p></div><footer>&copy; now</footer></body></html>"""


def test_what_is_left_out_and_how_blocks_join():
    assert text_of(PAGE) == "Title & more\nFirst bold text here <ok> x\nSecond one, unclosed\none\ntwo\nsaid"


@pytest.mark.parametrize("page", ["", " ", "plain words", "<", "a < b and c > d", "<p>x", "</div></div>y", "<div" * 2000, "<div>" * 3000 + "deep", "&#x41;&bogus;&#0;", "<!-- open", "<script>open", "<p>" + "w " * 100_000])
def test_odd_pages_do_not_fail(page):
    text_of(page)


def test_attributes_are_read_by_name():
    kept = '<div style="overflow:hidden" data-id="ad" aria-hidden="false" class=content><p>stays</p></div>'
    gone = '<div class="userComments"><p>goes</p></div><div hidden><p>goes</p></div><div id="sideBar"><p>goes</p></div><div role=navigation>goes</div>'
    assert text_of(f"<body>{kept}{gone}</body>", "#page>body") == "stays"


def test_odd_texts():
    assert text_of("plain  words\n here") == "plain words here" and text_of("a < b") == "a < b" and text_of("<p>&#x41;b&eacute;") == "Abé"


def test_a_host_votes_for_its_usual_path(spark):
    usual = '<html><body><div class="post-{}"><p>{}</p></div><div class="long"><p>{}</p></div></body></html>'
    pages = [(i, f"http://h.example/{i}", usual.format(i, "words " * 30, "x")) for i in range(9)]
    pages.append((9, "http://h.example/9", usual.format(9, "short", "a much longer text than that of the post " * 3)))
    pages += [(10, "http://other.example/", usual.format(1, "short", "a much longer text than the post " * 3)), (11, None, None), (12, "http://h.example/9", ""), (9, "http://h.example/9", pages[9][2])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    rows = html.main_text(df).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == 14 and texts[9] == "short" and texts[0].startswith("words") and texts[10].startswith("a much") and texts[11] == texts[12] == ""
    assert html.main_text(df.where("false")).count() == 0


def test_the_whole_article_is_taken_however_long_its_inner_container_is(spark):
    page = "<body><div class=other>Other</div><article class=post><h1>Title</h1><p class=lead>Lead</p><div><div class=content><p>{}</p></div></div><section class=more><p>More</p></section></article></body>"
    pages = [(i, "http://n.example/", page.format("word " * n)) for i, n in enumerate((5, 400, 4000))] + [(3, "http://m.example/", "<main><section class=a><p>" + "one " * 900 + "</p></section><section class=b><p>two</p></section></main>")]
    rows = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [rows[i] for i in range(3)] == ["\n".join(["Title", "Lead", " ".join(["word"] * n), "More"]) for n in (5, 400, 4000)]
    assert rows[3].endswith("one\ntwo")


BODY = "<h1>Title</h1><p>" + "A text of the article with several words. " * 8 + "</p>"
WANT = "Title\n" + " ".join(["A text of the article with several words."] * 8)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="site has-sidebar"><div class=post>{BODY}</div></div></body>',
        f'<body><div class="content no-sidebar">{BODY}</div></body>',
        f'<body><div id="page" class="nav-open"><div class=entry>{BODY}</div></div></body>',
        f'<body><div class="widget sidebar-right"><div class=x>{BODY}</div></div></body>',
        f'<body><form id=aspnet><div class=x>{BODY}</div></form></body>',
        f'<body><div class=post>{BODY}<ol class="commentlist"><li><p>{"A reader says very much about it. " * 60}</p></li></ol></div></body>',
        f'<body><div class=post><header>{BODY[:14]}</header>{BODY[14:]}</div><header><a href=/>Home of the site</a></header></body>',
        f'<body><div class=post>{BODY.replace("</p>", "")}<span class="ad">Buy <b>now</b></span><span hidden>no</span><a class="share" href=#>Share</a><i aria-hidden="true">x</i><em style="display: none">y</em></p></div></body>',
        f'<body><div class=post>{BODY}<div aria-hidden="true">no</div><div style="display:none">no</div></div><div class=ad-slot>Advert</div></body>',
    ],
)
def test_names_and_hidden_parts(spark, page):
    """Pages without <article>, with others of their host that vote."""
    rows = html.main_text(spark.createDataFrame([(i, "http://h.example/", page) for i in range(3)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in rows] == [WANT] * 3


@pytest.mark.parametrize("sign", ['h2 id="social"', 'h3 id="comments-on-method"', 'p class="related-work"', 'p id="reply"', 'div id="post-story-share"', 'div class="share"', 'section class="notice"', 'li id="footer"', 'h2 class="alert-levels"'])
def test_articles_keep_what_only_a_name_speaks_against(spark, sign):
    tag = sign.split()[0]
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First words.</p><{sign}>These are words of the article</{tag}><p>Last <span class='ad-hoc' id='ad'>words</span> with <code>x <span class=comment># kept</span></code>.</p></article></body>"
    rows = html.main_text(spark.createDataFrame([(1, "http://h.example/", page)], "page_id long, url string, html string")).collect()
    assert rows[0]["text"] == "Title\nFirst words.\nThese are words of the article\nLast words with x # kept."


def test_headings_may_be_called_anything():
    words = sorted(html._SURE | html._MAYBE | html._COMMENTS)
    body = "".join(f'<h2 id="{w}">On {w}</h2><p id="the-{w}">Some text.</p>' for w in words)
    assert text_of(f"<body><article>{body}</article></body>") == "\n".join(f"On {w}\nSome text." for w in words)


def test_two_signs_take_a_part_of_an_article_out():
    body = "<p>" + "Words of the article. " * 20 + "</p>"
    gone = '<div class="related"><ul><li><a href=/1>One more</a></li><li><a href=/2>Another one</a></li></ul></div><div class="share-buttons"><a href=#>Share</a></div><div class="notice"><form><p>Enter your name</p></form></div><div class="ad-slot">Buy!</div><div class="userComments"><p>Nice.</p></div><div class="newsletter-box">Sign up</div>'
    assert text_of(f"<body><article>{body}{gone}</article></body>") == ("Words of the article. " * 20).strip()


def test_deep_pages_take_time_by_length(spark):
    """50,000 levels with names of their own and texts on each, unclosed or closed wrongly."""
    n = 50_000
    pages = ["<article>" + "".join(f"<div class=c{k % 7}><p>t" for k in range(n)), "<blockquote>" * n + "x" + "</div>" * n, "<ul><li>" * n + "y", "".join(f"<section id=a{k}><h2>h" for k in range(n)) + "</section>" * n]
    began = time.time()
    rows = html.main_text(spark.createDataFrame([(k, "http://deep.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[0] == "\n".join(["t"] * n) and texts[1] == "x" and texts[2] == "y" and len(texts) == 4
    assert time.time() - began < 120


def test_voted_paths_without_article(spark, sf):
    """The test tables' pages with the article as a plain div among others: the host's vote finds it on all of them."""
    pages = [(r["page_id"], r["url"], r["html"].replace("<article>", '<div class="story-text">').replace("</article>", "</div>"), r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    schema = "page_id long, url string, html string"
    plain = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame([(a, b, d) for a, b, _, d in pages], schema)).collect()}
    voted = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame([(a, b, c) for a, b, c, _ in pages], schema)).collect()}
    assert sum(voted[k] == plain[k] for k in plain) >= 0.99 * len(plain)
