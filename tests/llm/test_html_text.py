"""Main text of pages: furniture by name, templates by count, odd and hostile markup, tables with nulls."""

import time

import pytest

from foliant.llm import html_text


def extracted(spark, pages, schema="page_id long, url string, html string"):
    return {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, schema)).collect()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='page-with-sidebar'><p>text</p></div>", "text"),
        ("<div class='no-sidebar'><p>text</p></div>", "text"),
        ("<article><p>a</p><div class='legal-analysis'><p>text</p></div></article>", "a\n\ntext"),
        ("<article><header><h1>Title</h1></header><p>text</p></article>", "Title\n\ntext"),
        ("<header><h1>Site</h1></header><p>text</p>", "text"),
        ("<div class='sidebar'><p>short</p></div><p>text that is longer than what is beside it</p>", "text that is longer than what is beside it"),
        ("<div id='siteFooter'>f</div><div class='main-nav top'>n</div><p>some text</p>", "some text"),
        ("<div class='widget'><article><p>text</p></article></div>", "text"),
        ("<div class='comments'><p>" + "a long comment " * 20 + "</p></div><p>text</p>", "text"),
        ("<form id='aspnet'><h1>t</h1><p>text</p><input></form>", "t\n\ntext"),
        ("<form>name <input></form><p>the text of the page</p>", "the text of the page"),
        ("<aside><article><p>teaser</p></article></aside><article><p>t</p></article><p>the main text of the page, outside</p>", "t\n\nthe main text of the page, outside"),
        ("<p title='a > b'>q</p><p it's>b", "q\n\nb"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("a&nbsp;&amp;&#x41;\n\t b<br>c", "a &A b c"),
        ("<p hidden>h</p><p>t</p><textarea><p>x</textarea><title>t</title>", "t"),
        ("<p class='over hidden'>t</p>", "t"),
        ("", ""), ("<p", ""), ("<!-- <p>x</p>", ""), ("no markup", "no markup"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [lambda n: "<a " * n + '"', lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<div>" * n + "</x>" * n, lambda n: "<li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: '<a x="' * n, lambda n: "<" * n, lambda n: "<a " + "x='y " * n, lambda n: "<!--" * n])
def test_hostile_pages_take_time_in_step_with_their_length(page):
    begin = time.process_time()
    html_text.main_text(page(100_000))
    assert time.process_time() - begin < 3


def test_templates_decide_where_no_name_does(spark):
    """Hosts without semantic tags: notices go by their count alone; without the count they would stay."""
    shell = "<div><div><p>Read our daily letter</p><p>join now</p></div><div><p>story {0} begins</p><p>and ends {0}</p></div><div>(c) the paper</div></div>"
    pages = [(i, "https://paper.org/a", shell.format(i)) for i in range(12)]
    assert extracted(spark, pages) == {i: f"story {i} begins\n\nand ends {i}" for i in range(12)}
    assert "daily letter" in html_text.main_text(pages[0][2])
    alone = [(i, f"https://paper{i}.org/a", p) for i, _, p in pages]  # one page a host: nothing recurs
    assert all("daily letter" in t for t in extracted(spark, alone).values())


def test_nulls_ties_and_extra_columns(spark):
    rows = [(1, None, None, "a", 1, "x"), (1, "", "", "b", 2, "y"), (None, "odd", "<p>t</p>", None, 3, "z"), (2, "http://h/", "<p>t</p>", "c", 4, "w")] + [(3, "http://h/", "<p>u</p>", "d", 5, "v")] * 9
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, hash long, text string")
    out = html_text.extract_main_text(df)
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "hash", "text"])
    assert sorted((r.hash, r.text) for r in out.collect()) == [(1, ""), (2, ""), (3, "t"), (4, "t")] + [(5, "u")] * 9


def test_long_page_and_empty_table(spark):
    long = "".join(f"<p>word {i}</p>" for i in range(200_000))
    assert extracted(spark, [(1, "u", long)])[1].endswith("word 199999")
    assert extracted(spark, []) == {}


def test_a_page():
    page = "<nav>menu</nav><article><h1>T &amp; t</h1><p>one<br>two<p>three<div class='comments'>no</div><script>x</script></article><footer>f</footer>"
    assert html_text.main_text(page) == "T & t\n\none two\n\nthree"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""


def test_templates(spark):
    pages = [(i, "http://h.org/x", f"<div><span>same words</span></div><p>page {i}</p>") for i in range(8)] + [(8, None, None)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"page {i}" for i in range(8)}, 8: ""}


def test_templates_inside_articles(spark):
    """What recurs inside an article goes, whatever its class; copies of a whole article, and articles that hold nothing else, stay."""
    shell = "<body><article><h1>t{0}</h1><p>page {0}</p><div><p>share this</p></div></article><main><p>also {0}</p></main></body>"
    copy = "<article><h1>copy</h1><p>all the same</p></article>"
    pages = [(i, "http://h.org/x", shell.format(i)) for i in range(8)] + [(8 + i, "http://copies.org/", copy) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"t{i}\n\npage {i}\n\nalso {i}" for i in range(8)}, **{8 + i: "copy\n\nall the same" for i in range(8)}}


def test_templates_of_a_section(spark):
    """On a host of 400 pages, a notice that stands on 10 % of them goes; one on 19 pages, short of the root of 400, stays."""
    shell = "<article><p>page {}</p>{}{}</article>"
    pages = [(i, "http://hot.org/x", shell.format(i, "<div>notice</div>" if i < 40 else "", "<div>rare</div>" if i >= 381 else "")) for i in range(400)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"page {i}" + ("\n\nrare" if i >= 381 else "") for i in range(400)}


def test_rows_that_repeat_count_once(spark):
    """Five equal rows make no template of a line that one other article has, too; nor do ten with ids of their own."""
    page = lambda x, last: f"<html><body><article><h1>{x}</h1><div><p>{x} {x}.</p></div>{last}</article></body></html>"
    for last in ("<p>Shared line of words.</p>", "<div><p>Shared line</p><p>of words.</p></div>"):
        rows = [(k, "http://h.example/a", page("Alpha", last)) for k in range(5)] + [(9, "http://h.example/b", page("Beta", last))]
        got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[9].startswith("Beta") and "Shared line" in got[9] and got[9].rstrip(".").endswith("of words") and got[0] == got[4]


def test_paragraphs_of_articles_stay_and_boxes_in_them_go(spark):
    page = lambda k: f"<html><body><article><h1>Title {k}</h1><p>Own text of page {k}.</p><p>A passage that all quote.</p><div><p>More from</p><p>this site</p></div></article></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)]
    for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Title {r.page_id}\n\nOwn text of page {r.page_id}.\n\nA passage that all quote."
