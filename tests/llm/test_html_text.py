"""Main text of pages: against the article that the tables' pages are built from, and small pages of other shapes."""

import html
import re
import time

import pytest

from clinspan.llm import html_text

SF = "/root/testdata/sf0.001"
P = "<p>This is a long paragraph of the article, with many words in it and no links at all.</p>"
LINE = "This is a long paragraph of the article, with many words in it and no links at all."


def plain(page):
    """The blocks of the article element of a page that has one, without a parser."""
    found = re.search(r"(?s)<article>(.*)</article>", page or "")
    blocks = re.split(r"</?(?:p|h1)[^>]*>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.query(spark, SF).collect()}
    assert len(got) == len(pages)
    for page in pages:
        row = got[page["page_id"]]
        assert (row["url"], row["text"], row["n_chars"]) == (page["url"], plain(page["html"]), len(plain(page["html"])))


CASES = {
    "": "",
    "   ": "",
    "just text &amp; more": "just text & more",
    f"<nav><ul><li><a href='/a'>A</a></li></ul></nav><article><h1>T</h1>{P}<p>Short.</p></article><footer>&copy; us</footer>": f"T\n{LINE}\nShort.",
    # no element says where the article is
    f"<div id='top'><a href=1>Home</a> <a href=2>News</a></div><div class='wrap'><div class='c'><h1>Title</h1>{P * 4}<p>Short.</p></div><div class='r'><a href=1>one teaser</a><a href=2>another teaser</a></div></div>": "\n".join(["Title", *[LINE] * 4, "Short."]),
    # comments of readers are longer than the article, and articles by their elements
    f"<article><header><h1>T</h1></header>{P}<footer>tags</footer></article><section id='comments'><article class='comment'>{P * 9}</article></section>": f"T\n{LINE}",
    f"<main>{P}<aside>{P * 3}</aside><form><label>Name</label><input></form><div class='ad-slot'>{P}</div><div role='dialog'>{P}</div></main>": LINE,
    # an article in two parts, a notice beside it
    f"<div id=content><h1>Hi</h1><div><h2>A</h2>{P * 3}</div><div><h2>B</h2>{P * 2}</div></div><div class='cookie-notice'>{P}</div>": "\n".join(["Hi", "A", *[LINE] * 3, "B", *[LINE] * 2]),
    # markup that isn't closed, or is no markup
    "<article><p><b>One<br><p>Two <i>and</i> three<p>a < b<p>&eacute;t&eacute; &#8212; x&nbsp;y": "One\nTwo and three\na < b\nété — x y",
    "<article><script>if (a < b) { '</p>' }</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><!--> <p>too</p></article>": "yes\ntoo",
    "<article><p>a<span hidden>b <span>c</span></span>d<span class='ad'>e</span></p><p style='display: none'>f</p></article>": "ad",
    "<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>x<td>y</table></article>": "one\ntwo\nthree\nx\ny",
    "<nav><a href=1>only</a></nav><footer>these</footer>": "",
    "<body class='no-sidebar'><div class='with-sidebar'>" + P + "</div>": LINE,
}


@pytest.mark.parametrize("page", list(CASES))
def test_extract(page):
    assert html_text.extract(page) == CASES[page]


def test_nothing_of_a_long_article_is_dropped():
    words = [f"word{i}" for i in range(100_000)]
    page = "<article>" + "".join(f"<p>{' '.join(words[i : i + 10])}</p>" for i in range(0, len(words), 10)) + "</article>"
    assert html_text.extract(page).split() == words


@pytest.mark.parametrize("piece", ["<", '<a "', "<div>", '<a href="', "</p>", "<!--", "<li>", "<b><div>", "<script>", "<span class=ad>", "&", "<ul><li>", "<a b='>", "<p><table>"])
def test_linear(piece):
    began = time.perf_counter()
    html_text.extract(piece * 50_000)
    assert time.perf_counter() - began < 5


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", "<p>b</p>", "z"), (1, "u", "<p>b</p>", "z")], "page_id int, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (None, None, "a", 1), (1, "u", "b", 1), (1, "u", "b", 1)], key=repr)
    assert html_text.extract_pages(df.limit(0)).collect() == []
