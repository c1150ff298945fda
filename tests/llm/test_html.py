import html
import re

import pytest

from ebbflow.llm import html_extract as x
from ebbflow.llm.common import table
from ebbflow.llm.dom import blocks, parse

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head>
<body class="has-ads sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-banner">We use cookies</div><main><article><header><h1>Big &amp; bold</h1></header>
<p>First <b>para<i>graph</i></b>&nbsp;here<br>goes   on<p>Second &lt;one&gt;<ul><li>a<li>b</ul>
<div class="ad-slot"><p>Buy!</p></div><form><input><p>Name</p></form><blockquote>Quote</blockquote>
<section id="comments"><p>Great!</p></section><noscript>off</noscript><!-- <p>hidden</p> -->
<table><tr><td>x<td>y</table><span class="share">Share</span> tail</article></main>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""
WANT = "Big & bold\nFirst paragraph here goes on\nSecond <one>\na\nb\nQuote\nx\ny\ntail"


def pages(spark, rows):
    schema = "page_id long, url string, html string, host string, wrapper string, path string"
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], schema).repartition(2)


def texts(spark, rows):
    return {r.page_id: r.text for r in x.main_text(pages(spark, rows)).collect()}


def test_one_page():
    assert x.extract(PAGE, None) == WANT


@pytest.mark.parametrize("page", ["", "plain text", "<p>a<p>b", "<", "<a href='x>broken", "</p></div>", "<p", "a < b &amp; c", "<b>x</b>y"])
def test_odd_pages(page):
    assert x.extract(page, None) == {
        "plain text": "plain text", "<p>a<p>b": "a\nb", "<": "<", "a < b &amp; c": "a < b & c", "<b>x</b>y": "xy", "<a href='x>broken": "broken",
    }.get(page, "")


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "end" + "</div>" * 3000
    assert blocks(parse(deep)) == ["end"]
    assert x.skeleton(parse(deep))[3] == 3
    assert len(x.extract("<p>word</p>" * 20_000, None)) == 5 * 20_000 - 1


def templated(k):
    more = "".join(f"<p>Paragraph {k} {j} has its own words.</p>" for j in range(2 + k % 3))
    return (
        f"<html><body><div class='wrap'><div class='top'>The Daily Page</div><div class='links'>Home | About | Help</div>"
        f"<div class='story-box'><h1>Story {k}</h1>{more}<div class='tools'>Print this page</div></div>"
        f"<div class='bottom'>All rights kept</div></div></body></html>"
    )


def test_wrapper_is_induced_without_telling_names(spark):
    rows = [(k, f"http://a.example/{k}", templated(k)) for k in range(12)]
    for k, text in texts(spark, rows).items():
        assert text == "\n".join([f"Story {k}", *(f"Paragraph {k} {j} has its own words." for j in range(2 + k % 3))])


def test_hosts_too_many_to_ship(spark, monkeypatch):
    rows = [(k, f"http://a{k % 3}.example/{k}", templated(k)) for k in range(12)]
    shipped = texts(spark, rows)
    monkeypatch.setattr(x, "SHIPPED_BYTES", 0)
    assert texts(spark, rows) == shipped


def test_copies_on_a_host_stay(spark):
    rows = [(k, f"http://a.example/{k}", PAGE) for k in range(5)] + [(9, "http://b.example/", PAGE)]
    assert set(texts(spark, rows).values()) == {WANT}


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://a.example", PAGE), (3, "http://a.example", PAGE), (None, "http://a.example", "<p>x</p>")]
    found = x.main_text(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in found if r.page_id != 3) == sorted(
        [("1", None, "", 0), ("2", "no url", "", 0), ("None", "http://a.example", "x", 1)], key=str
    )
    assert [r.text for r in found if r.page_id == 3] == [WANT, WANT]
    assert x.main_text(pages(spark, [])).count() == 0


def test_simple_tree_matching():
    a, b = (x.skeleton(parse(h)) for h in ("<div><p>1</p><ul><li>x</ul><h2>2</h2></div>", "<div><ul><li>y</ul><h2>3</h2><p>4</p></div>"))
    pairs = []
    assert x.match(a, b, pairs) == 5  # root, div, ul, li, h2
    assert [p[0][0] for p in pairs] == ["", "div", "h2", "ul", "li"] and len(pairs) == 5


def story(k):
    return [f"Story {k}", *(f"Paragraph {k} {j} has its own words." for j in range(2 + k % 3))]


def test_template_inside_an_article_goes(spark):
    rows = [(k, f"http://a.example/{k}", templated(k).replace("<div class='story-box'>", "<article>").replace("page</div></div>", "page</div></article>")) for k in range(12)]
    assert {k: t.split("\n") for k, t in texts(spark, rows).items()} == {k: story(k) for k in range(12)}


def recipe(k):
    steps = "".join(f"<li>Step {k} {j}</li>" for j in range(3))
    return (
        f"<html><body><div class='links'>Home | About</div><article><h1>Dish {k}</h1><p class='by'>By Jane Doe</p><h2>Ingredients</h2>"
        f"<p>{k} eggs and flour</p><h2>Method</h2><ol>{steps}</ol><div class='tools'>Print this page</div></article></body></html>"
    )


def test_recurring_headings_and_bylines_stay(spark):
    got = texts(spark, [(k, f"http://a.example/{k}", recipe(k)) for k in range(12)])
    for k, text in got.items():
        own = [f"Dish {k}", "By Jane Doe", "Ingredients", f"{k} eggs and flour", "Method", *(f"Step {k} {j}" for j in range(3))]
        assert text.split("\n") == own


@pytest.mark.parametrize("body", ["<body>", "<body class='page-id-{k} post-{word}'>"])
def test_ids_of_one_page_do_not_hinder_alignment(spark, body):
    words = [f"title-{a}{b}" for a in "abc" for b in "wxyz"]
    rows = [
        (k, f"http://a.example/{k}", templated(k).replace("<body>", body.format(k=k, word=words[k]))
         .replace("<div class='story-box'>", f"<article id='post-{k}' class='{words[k]}'>").replace("page</div></div>", "page</div></article>"))
        for k in range(12)
    ]
    assert {k: t.split("\n") for k, t in texts(spark, rows).items()} == {k: story(k) for k in range(12)}


def test_one_deviating_page_keeps_the_template(spark):
    rows = [(k, f"http://a.example/{k}", templated(k)) for k in range(12)]
    rows[5] = (5, rows[5][1], rows[5][2].replace("Print this page", "Print page five"))
    got = {k: t.split("\n") for k, t in texts(spark, rows).items()}
    assert got == {k: story(k) + ["Print page five"] * (k == 5) for k in range(12)}


def test_content_below_many_levels(spark):
    def page(k):
        inner = f"<div class='links'>Home | About</div><article><h1>Story {k}</h1><p>Words of {k}.</p><div class='tools'>Print</div></article>"
        return "<html><body>" + "<div><div class='x'>Top</div>" * 30 + inner + "</div>" * 30 + "</body></html>"

    got = texts(spark, [(k, f"http://a.example/{k}", page(k)) for k in range(6)])
    assert got == {k: f"Story {k}\nWords of {k}." for k in range(6)}


def test_matching_of_long_lists_is_exact():
    pages = ("<div>" + "<p>a</p><h2>b</h2>" * 200 + "</div>", "<div><h3>c</h3><h2>b</h2>" + "<p>a</p><h2>b</h2>" * 199 + "<ul><li>x</ul></div>")
    a, b = (x.skeleton(parse(h)) for h in pages)
    pairs = []
    assert x.match(a, b, pairs) == len(pairs) == 401  # root, div, 399 of the 400 children
    deep = x.skeleton(parse("<div><p>a</p>" * 3000)), x.skeleton(parse("<div><p>a</p>" * 2999 + "<ul><li>b</ul>"))
    assert x.match(*deep, []) == 1 + 2 * 2999
    assert x.unpacked(x.packed(a))[:8] == [*a[:5], x.unpacked(x.packed(a))[5], *a[6:8]]


def reference(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_documents_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: (r.text, r.n_chars) for r in x.op10_html(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        assert got[r.page_id] == (reference(r.html), len(reference(r.html)))
