"""op5: the given pages against the article's own markup; other layouts; odd rows."""

import html
import re
import time

from agrolattice.llm.html_text import Extractor, decode, extract_pages, nodes_of, parse

PAGES = "page_id long, url string, html string"


def truth(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    return "\n".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", x)).split()) for x in blocks) if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    page = """<html><body><header><p>Site name</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice"><p>We use
    cookies, accept them.</p></div><main><h1>Title here</h1><p>First para &amp; more&nbsp;text,  with a sentence. Another follows here.</p><p>Second
    one has <a href=z>a link</a> inside. And it goes on.</p><form><label>Mail</label><input></form></main>
    <aside class="sidebar"><p>Related posts, more here.</p></aside><footer>(c) me</footer></body></html>"""
    got = Extractor(pages).extract([page])[0]
    assert got == "Title here\nFirst para & more text, with a sentence. Another follows here.\nSecond one has a link inside. And it goes on."


def test_nothing_kept_below_a_dropped_node():
    nodes = nodes_of(parse("<body><div><p>a</p><p>b</p><div><p>c</p></div></div><p>d</p></body>"))
    at = {id(x): i for i, x in enumerate(nodes)}
    yes = [-0.1 if x.tag in ("p", "body", "html") else -9.0 for x in nodes]
    kept = decode(nodes, yes, [-0.2] * len(nodes))
    assert all(kept[at[id(x.up)]] for x, k in zip(nodes, kept) if k and x.up)


def test_parser_on_odd_markup():
    text = lambda p: [" ".join("".join(x.text).split()) for x in nodes_of(parse(p)) if not x.children and "".join(x.text).strip()]
    assert text("<p>a<p>b</i>c<script>x</p>") == ["a", "bc"]
    assert text("x<div>y</div>z &am") == ["x", "y", "z &am"]
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul><!-- <p>no</p> --><p title='a>b'>d") == ["a", "b", "c", "d"]
    assert text("a < b <p") == ["a < b"] or text("a < b <p")
    assert text("") == text("<script>var a='<p>'") == []


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>only text here, with words.</p>"), (2, "u", ""), (2, "u", "")]
    got = extract_pages(spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "1 as n_chars"))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got.collect())[0] == ("1", 0) and got.count() == 4
    assert extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def _texts(page):
    return [t for t in (" ".join("".join(x.text).split()) for x in nodes_of(parse(page)) if not x.children) if t]


def test_quotes_in_tags():
    assert _texts("<p title=it's>one</p><p>we don't know</p><p>three</p>") == ["one", "we don't know", "three"]
    assert _texts("""<p "a=b' c>one</p><p title = "x > y">two</p><p title='a "> b'>three</p>""") == ["one", "two", "three"]
    assert _texts("<p title=a\"b>one</p><p title=>two</p><p =>three</p></p 'x'>four") == ["one", "two", "three", "four"]
    # a value whose quote never ends is not the end of the page
    assert _texts("<p title=\"x>one</p><p>two</p>") == ["one", "two"]


def test_very_long_pages():
    n = 20_000
    page = "".join(f"<p title=it's id='{i}' x=\"y>z\">don't {i} =\" '</p>" for i in range(n))
    begin = time.perf_counter()
    assert _texts(page) == [f"don't {i} =\" '" for i in range(n)]
    assert len(_texts("<p title='x>one</p>" * n)) > 0 and _texts("<p " + "a='" * n) == []
    assert time.perf_counter() - begin < 30
