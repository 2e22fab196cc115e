import html as entities
import pathlib
import re

import pytest

from sparkloom.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>A &amp; B</h1><p>by someone</p></header><p>First <b>bo</b>ld&nbsp;text<br>same block
 <p>Second &lt;p&gt; <!-- gone --> &eacute;<ul><li>one<li>two</ul><form><input> Send</form><aside>See also</aside>
<div>loose <span>text</span></div><section id="comments"><article><p>nice!</p></article></section></article>
<aside>side</aside><footer>&copy;</footer></body></html>"""
TEXT = "A & B\n\nFirst bold text same block\n\nSecond <p> é\n\none\n\ntwo\n\nloose text"


def texts(spark, pages, url_col="url"):
    df = spark.createDataFrame([(*p, "x") for p in pages], f"page_id bigint, {url_col} string, html string, text string")
    return sorted(((r.page_id, r.text) for r in h.extract_main_text(df).collect()), key=str)


def test_declared_article(spark):
    pages = [(1, "http://a.b/x", PAGE), (1, "http://a.b/x", PAGE), (2, "http://c.d/", PAGE.replace("</article>\n", "")), (3, None, None), (4, "", ""), (None, "nohost", "<p>x")]
    got = texts(spark, pages)
    assert got == sorted([(1, TEXT), (1, TEXT), (2, TEXT), (3, ""), (4, ""), (None, "x")], key=str)


def test_template_without_declared_article(spark):
    def page(i, body):
        return f"<html><body><div class=top>Daily Things</div><div class=c1>{body}</div><div class=c2><p>All rights kept. Long standing text on every page of this host, longer than most of them are</p></div>"

    pages = [(i, "https://Host.example/p", page(i, f"<h2>Title {i}</h2><p>Some own text {i}.</p>" + f"<p>more {i}</p>" * i)) for i in range(6)]
    want = [(i, f"Title {i}\n\nSome own text {i}." + f"\n\nmore {i}" * i) for i in range(6)]
    assert texts(spark, pages) == want


def test_classes(spark):
    pages = [(i, "http://a/", f"<html><body><nav>n</nav><div><p>x{i}</p>" + "<p><i>y</i></p>" * i + "</div></body></html>") for i in range(5)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = h.deduce_templates(df).collect()
    skeleton = next(r for r in found if r.once and r.paths)
    assert skeleton.paths == [">html", ">html>body", ">html>body>div", ">html>body>nav"] and skeleton.parent is None and skeleton.support == 5
    nested = {r.paths[0]: r for r in found if r.paths and not r.once}
    assert nested[">html>body>div>p"].parent == skeleton["class"]
    assert nested[">html>body>div>p>i"].parent == nested[">html>body>div>p"]["class"] and nested[">html>body>div>p>i"].support == 4


def test_broken_markup():
    for raw in ("<", "<p", "<!--", "<script>", "a<b", "</p></p>x", "<p class='", "&#x110000; &bogus;", "<div" * 50, "\x00<p>\x00"):
        h.main_text(raw, set(), set())
    assert h.main_text("<nav><ul><li>menu<article><p>text", set(), set()) == "text"
    assert h.main_text("<p>" + "word " * 200_000, set(), set()) == ("word " * 200_000).strip()


def test_empty_table(spark):
    assert texts(spark, []) == []


def test_given_pages_against_a_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    if not pathlib.Path(sf).exists():
        pytest.skip("no test tables")

    def plain(raw):
        inner = re.search(r"<article>(.*?)(</article>|$)", raw or "", re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        return "\n\n".join(t for t in (" ".join(entities.unescape(b).split()) for b in blocks) if t)

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in h.op3_html_extraction(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_copies_of_an_article_are_not_template_text(spark):
    text = ["The same long article is told on this page and on its copy.", "It has another paragraph with words of its own."]
    page = lambda ts: "<body><div class='top'>Site name</div><div class='text'>" + "".join(f"<p>{t}</p>" for t in ts) + "</div></body>"
    rows = [(1, "http://h.example/1", page(text)), (2, "http://h.example/2", page(text)), (3, "http://h.example/3", page(["Quite another story, of cats and of dogs."])), (4, "http://h.example/4", page(["And a fourth one, about rain in the hills."]))]
    got = {r.page_id: r.text for r in h.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "\n\n".join(text) and got[3] == "Quite another story, of cats and of dogs."


def test_lists_quotations_and_tables_stay_with_their_article(spark):
    page = "<body><div class='text'><p>First the story in plain words.</p><ul><li>one thing, long enough to be more than the story itself</li><li>another</li></ul><blockquote><p>quoted words</p></blockquote><table><tr><td>cell</td></tr></table><section><p>last part</p></section></div></body>"
    got = h.extract_main_text(spark.createDataFrame([(1, "http://one.example/", page)], "page_id bigint, url string, html string")).first().text
    assert got.split("\n\n") == ["First the story in plain words.", "one thing, long enough to be more than the story itself", "another", "quoted words", "cell", "last part"]


def one(spark, page):
    return h.extract_main_text(spark.createDataFrame([(1, "http://one.example/", page)], "page_id bigint, url string, html string")).first().text


def test_words_inside_attribute_values_are_no_names(spark):
    page = """<article><h1>T</h1><p>One.</p><div style="overflow:hidden"><p>Two</p></div><p title="hidden gem">Three</p>
    <p data-hidden="false">Four</p><p width="id=ad">Five</p><p data-id="ad">Six</p><div class="x" class="ad"><p>Seven</p></div><p hidden>no</p></article>"""
    assert one(spark, page).split("\n\n") == ["T", "One.", "Two", "Three", "Four", "Five", "Six", "Seven"]


def test_an_articles_own_sections_stay_and_adverts_in_it_go(spark):
    page = """<article><p>One.</p><section id="reply"><p>The reply of the king.</p></section><div class="form"><p>On form.</p></div>
    <div class="search-results"><p>What was found.</p></div><div class="ad-slot"><p>Buy!</p></div><div id="comments"><p>me too</p></div></article>"""
    assert one(spark, page).split("\n\n") == ["One.", "The reply of the king.", "On form.", "What was found."]


def test_an_article_in_two_containers(spark):
    for page in (
        "<body><div class=a><p>First slot.</p></div><div class=b><p>Second slot.</p></div></body>",
        "<body><div class=a><article><p>First slot.</p></article></div><div class=b><article><p>Second slot.</p></article></div></body>",
        "<body><div class=a>First slot.</div><div class=b>Second slot.</div></body>",
    ):
        assert one(spark, page) == "First slot.\n\nSecond slot."


def test_site_text_inside_a_declared_article_goes(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>{'Own words of page ' + str(i) + '. '} {'They go on. ' * 9}</p><p>Follow us on every channel</p></article></body>"
    rows = [(i, "http://h.example/", page(i)) for i in range(6)]
    got = {r.page_id: r.text for r in h.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i].startswith(f"Title {i}\n\nOwn words") and "Follow" not in got[i] for i in range(6))


def test_given_pages_without_telling_names(spark):
    """The template finds the same text where nothing is named: the article, the menu, the advert and the footer are all plain divs."""
    sf = "/root/testdata/sf0.01"
    if not pathlib.Path(sf).exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: r.text for r in h.extract_main_text(pages).collect()}
    plain = pages.selectExpr("page_id", "url", r"""regexp_replace(regexp_replace(html, '<(/?)(article|nav|footer)>', '<$1div>'), ' class="ad"', '') AS html""")
    got = {r.page_id: r.text for r in h.extract_main_text(plain).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)


def test_words_of_subjects_and_stray_quotes_lose_nothing():
    from sparkloom.llm.html import parse

    kept = lambda page: [(b.text, b.apart) for b in parse(page)[1]]
    for about in ("post category-social tag-advertising", "post-12 category-newsletter", "related", "social"):
        assert kept(f'<article class="{about}"><h1>T</h1><p>One</p></article>') == [("T", False), ("One", False)]
    assert kept('<div class="social-science"><p>a</p></div>') == [("a", False)]
    inside = '<section class="related-work"><p>a</p></section><div class="share-price">b</div><div id="comments-on-law">c</div>'
    assert kept(f"<article>{inside}</article>") == [("a", False), ("b", False), ("c", False)]
    parts = ("comments-area", "site-nav", "social-share", "related-posts", "cookie-banner", "ad-slot-3", "site-header__nav")
    assert all(kept(f'<div class="{c}"><p>x</p></div>') == [("x", True)] for c in parts) and kept('<article class="comment">x</article>') == [("x", True)]
    assert kept("<p title=it's>Hello</p><p>Middle</p><p>don't stop</p>") == [("Hello", False), ("Middle", False), ("don't stop", False)]
    assert kept("<a href=\"x>y\" class='p>q'>k</a><p data-a = \"it's\">v</p>") == [("k", False), ("v", False)]


def test_long_broken_pages_take_time_by_their_length():
    import time

    from sparkloom.llm.html import parse

    for page in ("<b x" * 250_000 + "'", "<div>" * 50_000 + "x", "<p>" + "<b>y " * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<article>" * 50_000):
        began = time.perf_counter()
        parse(page)
        assert time.perf_counter() - began < 5
