"""Main text: the pages' articles, what stands beside them, broken markup."""

import html
import re

import pytest

from transvoc.llm import html_text as H
from transvoc.llm import queries, warc

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor sit amet " * 8


def one(x):
    return " ".join(x.split())


@pytest.mark.parametrize("page,want", [
    ("plain", "plain"), ("", ""), (None, ""), ("<p>a  b\n c</p>", "a b c"), ("<p>&lt;b&gt; &amp;amp; &eacute;&#x41;", "<b> &amp; éA"),
    ("<article><p>x</article><p>y</p>", "x"), ("<script>if (a < b) x='</p>'</script><p>t", "t"),
    ("<p>a</p><!-- <p>b</p> --><p>c</p>", "a\nc"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<p>a<b>b</b>c<br>d", "abc\nd"),
    ("<nav><p>menu<article><p>x</p></article>", "x"), ("<p>cut <a hre", "cut"),
    ("<div title='a > b'>t</div>", "t"), ("<table><tr><td>1<td>2</table>", "1\n2")])
def test_small_pages(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>",
                                  "<div itemprop=articleBody>{}</div>", "<div class=content>{}</div>"])
def test_beside_the_article(wrap):
    body = (f"<h1>Head</h1><p>{LONG}</p><div class='ad-slot'>Buy</div><aside>More</aside><p>{LONG}&amp;</p>"
            "<form><p>Your mail</p><input></form><p>End.</p>")
    page = (f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>"
            f"<nav><ul><li><a href=/>Home</a></ul></nav><div id='cookie-notice'><p>{LONG}cookies</div>"
            f"{wrap.format(body)}<div class='sidebar'><p>{LONG}side</p></div>"
            f"<section class='comments'><h2>Comments</h2><article class='comment'><p>{LONG}I disagree</p></article></section>"
            f"<footer>&copy; us</footer></body></html>")
    assert H.main_text(page) == "\n".join(["Head", one(LONG), one(LONG + "&"), "End."])


def test_line_blocks_without_marks():
    """No element names the article: surge and dive points alone."""
    menu = "".join(f"<p><a href={i}>Item {i} of the menu</a></p>" for i in range(8))
    page = f"<body><div>{menu}</div><h2>Head</h2><p>{LONG}<p>{LONG}<p>Short.<div>{menu}</div><p>tiny</p></body>"
    assert H.main_text(page) == "\n".join(["Head", one(LONG), one(LONG), "Short."])
    weights = [0, 0, 5, 200, 0, 90, 3, 0, 0, 0, 7, 0, 0, 0, 300]
    assert H.runs(weights) == [(2, 7), (14, 15)]


MARKS = {
    "nested": (f"<main><h1>Head</h1><p>Lead.</p><article><p>{LONG}</p></article></main>", ["Head", "Lead.", one(LONG)]),
    "body inside": (f"<article><h1>Head</h1><p>Lead.</p><div itemprop=articleBody><p>{LONG}</p></div></article>",
                    ["Head", "Lead.", one(LONG)]),
    "parts": (f"<article><p>{LONG}1</p></article><div class=ad>Buy</div><article><p>{LONG}2</p></article>"
              f"<p>Between.</p><article><p>{LONG}3</p></article>",
              [one(LONG + "1"), one(LONG + "2"), "Between.", one(LONG + "3")]),
    "teaser": (f"<article><p>Read this as well.</p></article><ul>{'<li><a href=/>Item</a></li>' * 4}</ul>"
               f"<div><p>{LONG}</p><p>{LONG}</p></div>", [one(LONG), one(LONG)]),
    "links beside": (f"<main><article><p>{LONG}</p></article><ul>{'<li><a href=/>Item</a></li>' * 8}</ul></main>",
                     [one(LONG)])}


@pytest.mark.parametrize("case", MARKS)
def test_marks_are_evidence(case):
    """The distribution runs on marked pages too: nested marks, parts, a mark that is not the article."""
    page, want = MARKS[case]
    assert H.main_text(page) == "\n".join(want)


NAMES = {
    "layout": (f'<div class="page has-sidebar"><article><p>{LONG}</p></article></div>', [one(LONG)]),
    "negated": (f'<div class="layout no-comments"><p>{LONG}</p></div><p>{LONG}</p><p>{LONG}</p>', [one(LONG)] * 3),
    "page": (f'<div class="content search-page"><div class="sidebar"><p>{LONG}</p></div><article><p>{LONG}</p><p>{LONG}</p>'
             f'</article></div>', [one(LONG)] * 2),
    "unmarked": (f'<div class="widget-page"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div>',
                 [one(LONG)] * 2),
    "inside": (f'<article><h2 id="social-impact">Impact</h2><p>{LONG}</p><section id="related-work"><p>Short.</p></section>'
               f'<div id="login"><p>Log in.</p></div><div class="notice"><p>{LONG}</p></div>'
               f'<div class="share"><a href=/>Post it</a></div><p>As <span class="search">said</span>.</p></article>',
               ["Impact", one(LONG), "Short.", "Log in.", one(LONG), "As said."]),
    "comments": (f'<article class="post comments-open"><p>{LONG}</p></article><footer>us</footer>', [one(LONG)]),
    "more comments than article": (
        f'<article><p>{LONG}</p></article><section class="comments">'
        f'{f"<article class=comment><p>{LONG}no</p></article>" * 9}</section>', [one(LONG)]),
    "teasers": (f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="related"><article><p>{LONG}no</p></article></div>',
                [one(LONG)] * 2)}


@pytest.mark.parametrize("case", NAMES)
def test_names_are_weak_evidence(case):
    page, want = NAMES[case]
    assert H.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("page,want", [
    ('<p>a <svg class="i"/> b</p><p>c</p>', "a b\nc"), ("<p>a <svg/> b <svg><title>t</title><p>z</svg> c</p><p>d", "a b c\nd"),
    ("<p>a <noscript> b</p><p>c</p><noscript>z</noscript><p>d</p>", "a b\nc\nd"), ("<p>a<iframe src=x></p><p>b</p>", "a\nb"),
    ("<template>z<p>z</p><template>z</template>z</template><p>a", "a"), ("<p>a</noscript> b", "a b"),
    ("<p>a <noscript><img src=x><p>z</noscript>b", "a b")])
def test_skipped_elements_do_not_swallow(page, want):
    assert H.main_text(page) == want
    assert warc.plain_text("text/html", page) == want


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert H.main_text(deep) == "x"
    many = "<article>" + "<p>line</p>" * 50_000 + "</article>"
    assert H.main_text(many).count("line") == 50_000


def test_query(spark):
    got = queries.op9_html_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r["page_id"]: r for r in got.collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inside = p["html"][p["html"].index("<article>"):p["html"].index("</article>")]
        blocks = (one(html.unescape(re.sub("<[^>]*>", "", b))) for b in re.split(r"<p>|</p>|<br>|</?h1>", inside))
        want = "\n".join(b for b in blocks if b)
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (want, len(want))


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    pages = spark.createDataFrame([(1, None, None, "t", 1), (2, "u", "", "t", 1), (2, "u", "<p>x", "t", 1),
                                   (2, "u", "<p>x", "t", 1), (None, None, "<p>y", None, None)], schema)
    rows = H.extract(pages).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "x", "x", "y"]
    assert H.extract(pages.limit(0)).collect() == []
