import html
import re
import time

from resultloom.llm.bindings import op10_html
from resultloom.llm.html import classify, extract, features, grow, labelled, blocks, main_text

TESTDATA = "/root/testdata/sf0.001"
TREE = grow(*labelled())


def test_query_takes_the_articles(spark):
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet").collect()
    got = {r.page_id: r for r in op10_html(spark, TESTDATA).collect()}
    for page in pages:
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert (got[page.page_id].url, got[page.page_id].text, got[page.page_id].n_chars) == (page.url, want, len(want))


def test_tree_fits_the_labelled_table():
    rows, main = labelled()
    assert (classify(TREE, rows) == main).all() and 20 < len(main) < 200


def test_other_layouts():
    page = """<html><body class="page"><header><a href="/">Site</a></header><div id="cookie-banner">We use cookies &amp; more.</div>
    <div class="menu"><a>One</a><a>Two</a></div><main><header><h1>Title &lt;one&gt;</h1></header><p>First&nbsp;paragraph with <b>bold</b> and <a href="x>y">a link</a> in it.
    <p>Second<br>line<script>if (a<b) "</p>"</script>.</p><div class="ad-slot">Buy this!</div><ul><li>item one<li>item two</ul>
    <form><label>Mail</label><input name="m"><button>Go</button></form></main>
    <section class="comments"><p>What a long and thoughtful reader comment this is, really.</p></section><aside>More to read</aside><footer>&copy; us</footer>"""
    want = "Title <one>\nFirst paragraph with bold and a link in it.\nSecond line.\nitem one\nitem two"
    assert main_text(page, TREE) == want


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (3, "u", "<p>"), (4, "u", "no markup, only a few plain words of text"), (5, "u", "<script>x" * 3),
            (6, "u", "<!-- <p>never shown</p>"), (7, "u", "<article>" + "<p>word word</p>" * 20000 + "</article>"), (None, "u", "<article><p>a < b & c</p></article>"),
            (8, "u", '<article><p class="x>open quote</p><p>next</p></article>'), (9, "u", "<div>" * 3000 + "deep words here" + "</div>" * 3000)]
    pages = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id): r.text for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows)
    assert got[1] == got[2] == got[3] == got[5] == got[6] == ""
    assert got[7] == "\n".join(["word word"] * 20000) and got[None] == "a < b & c" and got[4].startswith("no markup")
    assert extract(pages.limit(0)).collect() == []
    assert features([]).shape == (0, 9) and blocks("") == []


def test_class_names_count_whole():
    page = """<article><h1>Prices</h1><p class="share-price">The share price rose by two per cent in a day of calm trade on the exchange.</p>
    <div class="social-history"><p>The social history of the harbour is told here for the first time, in letters and songs.</p></div>
    <div class="share-buttons">Send this to a friend</div><div class="related-posts"><p>Other things that we have written, all of them good.</p></div></article>"""
    text = main_text(page, TREE)
    assert "share price rose" in text and "social history" in text and "Send this" not in text and "Other things" not in text


def test_a_page_in_one_form_keeps_its_article():
    inner = "<h1>Old site</h1>" + "<p>In older sites the whole body of a page stands in one form, with its article and all.</p>" * 4
    page = f"<body><form action=x><div class=menu><a>One</a><a>Two</a></div><article>{inner}</article></form><form><label>Mail address</label></form></body>"
    assert main_text(page, TREE).startswith("Old site\nIn older sites") and "Mail" not in main_text(page, TREE)


def test_deep_nesting_is_linear():
    start = time.perf_counter()
    for page in ("<div>" * 20000 + "text" + "</div>" * 20000, "<div><p>a" * 20000 + "</section>" * 20000, '<div class="' + "ad-" * 5000 + '">x'):
        blocks(page)
    assert time.perf_counter() - start < 4
