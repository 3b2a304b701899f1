"""Main text against the template of the pages, and hand-made pages."""

import html
import re

from valsieve.llm import html_text


def wanted(page):
    body = page[page.index("<article>"):page.index("</article>")]
    body = re.sub(r"</?b>", "", re.sub(r"<(?:/?(?:article|h1|p)|br)>", "\n", body))
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in html.unescape(body).split("\n")) if x)


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, wanted(r.html)) for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_page_without_article():
    page = (
        "<body><header><h1>Site</h1></header><div class='cookie-banner'>We use cookies and much more of them</div><div id=main><h1>Title</h1>"
        "<p>A paragraph of many words, long enough to count as text.<p>Second &amp; last&nbsp;\n one of them<div class=ad>buy</div></div>"
        "<aside>more</aside><div id='comments'><p>I liked this page very much, it has many words.</p></div><form><label>mail</label></form>"
        "<footer>&copy; x</footer></body>")
    assert html_text.main_text(page) == "Title\nA paragraph of many words, long enough to count as text.\nSecond & last one of them"


def test_broken_pages():
    cases = {
        "": "", "plain": "plain", "<article>a<script>var x='<p>no</p>'</script><b>b</i></article>": "a\nb", "<p>a<br/>b</p>": "a\nb",
        "<article><p>one<p>two</article><p>out": "one\ntwo", "<style>x</style>": "", "<article><header><h1>T</h1></header>x</article>": "T\nx",
    }
    assert {page: html_text.main_text(page) for page in cases} == cases
    assert len(html_text.main_text("<article>" + "<div>" * 2000 + "x" + "<p>y " * 3000)) > 3000


def test_null_empty_and_no_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "v", "<p>é</p>", 3)], "page_id bigint, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("1", "", 0), ("2", "é", 1), ("None", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


ARTICLE = "<article><h1>T</h1><p>A paragraph of many words, long enough to count as text.</p></article>"
LONG = "<p>A paragraph of many words, long enough to count as text.</p><div><p>And one more of them, of about the same length.</p></div>"


def test_wrappers_with_marked_names_are_content():
    names = ("content-area has-sidebar", "site no-sidebar", "layout-nav-left", "page-with-menu", "widget-area", "sidebar-layout", "search")
    for name in names:
        want = "T\nA paragraph of many words, long enough to count as text."
        assert html_text.main_text(f"<body><div class='{name}'><div class=ad>buy</div>{ARTICLE}</div></body>") == want, name
        nested = f"<body><a>Skip</a><div id=page class='{name}'><div class='{name}'>{ARTICLE}<div class=ad>buy</div></div></div></body>"
        assert html_text.main_text(nested) == want, name
        got = html_text.main_text(f"<body><a>Skip</a><div class='{name}'><div class=ad>buy</div>{LONG}</div></body>")
        assert "A paragraph of many" in got and "And one more" in got and "buy" not in got, name


def test_marked_elements_stay_out():
    comments = "<div id=comments><article class=comment><p>I liked this page very much, it has many words.</p></article></div>"
    related = "<div class='related-posts'><article><p>Short teaser</p></article></div>"
    page = f"<body><div id=post>{LONG}</div>{related}{comments}</body>"
    got = html_text.main_text(page)
    assert "A paragraph of many" in got and "liked" not in got and "teaser" not in got
    assert html_text.main_text(f"<body>{related}{ARTICLE}{comments}</body>") == "T\nA paragraph of many words, long enough to count as text."
    assert html_text.main_text("<body><div class=ad>buy</div></body>") == ""


def test_headings_and_short_cells_between_content():
    prose = "A paragraph of many words, long enough to count as text, and then some more words. " * 4
    page = f"<body><div><div><h1>T</h1></div><div>{prose}</div><div>yes</div><div>no</div><div>a</div><div>b</div><div>c</div><div>{prose}</div></div></body>"
    assert html_text.main_text(page).split("\n") == ["T", prose.strip(), "yes", "no", "a", "b", "c", prose.strip()]
