from __future__ import annotations

import re

import pytest

from rebuy.llm import html_extraction as H
from rebuy.llm.queries import op2_html_extraction
from tests.llm.helpers import awkward

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>
<!-- note --><div class="ad">Buy the best things that money can buy, today and tomorrow and on every other day of the week.</div>
<div id="cookie-notice">We use cookies to make this site work for you and for all of our many partners.</div>
<article><header><h1>A &amp; B &lt;ok&gt;</h1></header><p>First   paragraph
 with <b>bold &eacute; text.<br><p>Second, long enough to be taken for the text of an article by its ratio of text to tags.</p>
<p>No.</p><aside>See also this other story, which is of great interest to all who read this one.</aside>
<p>Last one &copy; 2020 &unknown; 3 < 4 &am</p><section class="comments"><p>A reader says that this is wrong, at some length, too.</p></section></article>
<form><label>Search</label><input type="text" value="x"><textarea>typed</textarea></form>
<footer>&copy; someone, with a long line of text that nobody reads but that is there on each and every page.</footer></body></html>"""


def test_article_text():
    assert H.main_text(PAGE).split("\n") == [
        "A & B <ok>",
        "First paragraph with bold é text.",
        "Second, long enough to be taken for the text of an article by its ratio of text to tags.",
        "No.",
        "Last one © 2020 &unknown; 3 < 4 &am",
    ]


@pytest.mark.parametrize("cut", range(0, len(PAGE), 37))
def test_any_truncation_is_read(cut):
    text = H.main_text(PAGE[:cut])
    assert "margin" not in text and "var t" not in text and "cookies" not in text and "money" not in text


def test_page_without_a_container():
    story = "".join(f"<p>Paragraph {k} has words enough to stand out from the menu and from the links around it.</p>" for k in range(5))
    page = f"<body><div>{'<a>one</a> ' * 8}</div>{story}<p>Short.</p>{story}<div>{'<a>two</a> ' * 9}</div></body>"
    lines = H.main_text(page).split("\n")
    assert len(lines) == 11 and lines[5] == "Short." and not any("one" in x.split() or "two" in x.split() for x in lines)


def test_defined_cases():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == H.main_text("<!-- x -->") == ""
    assert H.main_text("plain  text\n only") == "plain text only"
    assert H.main_text("<article><p>Hi.</p></article>") == "Hi."
    assert H.main_text("<article></article><p>out</p>") == "out"
    assert H.main_text("<p>" * 3000 + "deep") == "deep"
    assert H.main_text("<div>" * 3000 + "deep" + "</p></b>") == "deep"


def test_very_long_page():
    assert len(H.main_text("<article>" + "<p>Some words of text here.</p>" * 20_000 + "</article>").split("\n")) == 20_000


def test_table(spark):
    rows = [(1, "u", PAGE, "clash"), (None, None, None, "clash"), (2, "v", "", "clash"), (1, "u", PAGE, "clash")]
    rows += [(100 + k, "w", t, "clash") for k, (_, t) in enumerate(awkward())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = H.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    got = found.collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert sum(r.text == H.main_text(PAGE) for r in got) == 2
    assert H.extract(pages.filter("false")).count() == 0


def test_threshold_splits_two_clusters():
    cut = H.threshold([1.0, 2.0, 1.5, 50.0, 60.0])
    assert 2 < cut < 50
    assert H.threshold([3.0, 3.0]) < 3.0
    assert H.smoothed([5.0] * 7) == pytest.approx([5.0] * 7)


def test_query_joins_blocks_by_two_line_ends(spark, tmp_path):
    page = f"<nav><a>Home</a></nav><article><h1>Title</h1><p>{'One two three. ' * 9}</p><p>{'Four five six. ' * 9}</p></article>"
    story = "".join(f"<p>Paragraph {k} has words enough to stand out from the menu and from the links around it.</p>" for k in range(3))
    rows = [(1, "u", page), (2, "v", f"<div>{'<a>one</a> ' * 8}</div>{story}")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op2_html_extraction(spark, str(tmp_path)).collect()}
    assert got[1].text == "\n\n".join(["Title", " ".join(["One two three."] * 9), " ".join(["Four five six."] * 9)])
    assert got[2].text.count("\n\n") == 2 and got[2].text.count("\n") == 4
    assert all(r.n_chars == len(r.text) for r in got.values())


STORY = [f"Paragraph {k} has words enough to stand out from the menu and from the links around it." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in STORY)
CARDS = "".join(f"<article class='card'><p>Another story {k}, of some interest to readers.</p></article>" for k in range(20))


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content-sidebar-wrap'><main>{BODY}</main></div>",
        f"<div class='content-sidebar-wrap'><article>{BODY}</article><div class='sidebar'>Other things to read, at length.</div></div>",
        f"<div class='has-sidebar'><article>{BODY}</article></div>",
        f"<div id='page' class='footer-widgets no-comments'><nav><a>Home</a></nav><div><main>{BODY}</main></div></div>",
        f"<form><input name='state'><div>{'<a>one</a> ' * 8}</div><article>{BODY}</article></form>",
        f"<main><div class='content-sidebar-wrap'><article>{BODY}</article></div></main>",
        f"<div class='menu'><a>unclosed</a><article>{BODY}</article>",
        f"<article class='post tag-advertising category-related comments-open'>{BODY}</article>",
        f"<article>{BODY}</article><article class='comment'>{BODY.replace('Paragraph', 'Remark')}</article>",
        f"<article>{BODY}<article id='comment-7'>{BODY.replace('Paragraph', 'Remark')}</article></article>",
        f"<article>{BODY}</article><div class='related'>{CARDS}</div><div id='comments'>{CARDS}</div><div class='ad'>{CARDS}</div>",
        f"<article>{BODY}</article><div class='sidebar'>{CARDS}</div>",
        f"<div>{BODY}</div><div class='sidebar'>{CARDS}</div>",
        f"<div class='has-sidebar'>{BODY}</div>",
    ],
)
def test_layout_wrappers_and_foreign_articles(page):
    assert H.main_text(f"<html><body class='has-sidebar'>{page}</body></html>").split("\n") == STORY


LONG = "A sentence of the article that goes on for quite a while, with commas, and ends at last."


@pytest.mark.parametrize("name", ["search-for-truth", "share-of-voice", "related-to-history", "widget-theory", "notice-how-light-bends", "modal-logic", "banner-years"])
def test_names_alone_drop_no_article_text(name):
    html = f"<nav><a href='/'>x</a></nav><article><h1>T</h1><p>{LONG}</p><p class='{name}'>{LONG} Kept.</p><p>{LONG}</p></article>"
    assert H.main_text(html, "\n\n") == "\n\n".join(["T", LONG, f"{LONG} Kept.", LONG])


@pytest.mark.parametrize("name", ["share-buttons", "cookie-notice", "ad", "newsletter-signup", "related-posts", "comments", "social-links", "banner"])
def test_names_that_say_nothing_else_drop_blocks(name):
    html = f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></article>"
    assert H.main_text(html, "\n\n") == f"{LONG}\n\n{LONG}"


def test_doubtful_lines_of_links_are_dropped():
    links = "".join(f"<a href='/{k}'>Share this on network {k}</a> " for k in range(4))
    html = f"<article><p>{LONG}</p><div class='share-with-friends'>{links}</div><p>{LONG}</p></article>"
    assert H.main_text(html, "\n\n") == f"{LONG}\n\n{LONG}"


def test_heading_without_a_container_is_kept():
    html = f"<div><a href='/'>Home</a></div><div><a href='/b'>B</a></div><h1>Title</h1><p>By Ann.</p><p>{LONG}</p><p>{LONG}</p><div><a>x</a></div>"
    assert H.main_text(html, "\n\n").startswith("\n\n".join(["Title", "By Ann.", LONG, LONG]))


def plain_article(html: str) -> str:
    """Another way to the text of a page with one plain article: by regular expressions."""
    import html as entities

    inside = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    inside = re.sub(r"<(script|style|aside|form|nav|footer)\b.*?</\1>|<!--.*?-->", "", inside, flags=re.S)
    inside = re.sub(r"<div class=\"ad\">.*?</div>", "", inside, flags=re.S)
    marks = re.sub(r"</?(p|h[1-6]|ul|ol|li|div|blockquote|pre|table|tr|td|section|figure|figcaption)\b[^>]*>", "\x00", inside)
    parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br ?/?>", " ", p))).split()) for p in marks.split("\x00"))
    return "\n\n".join(p for p in parts if p)


def test_given_pages_match_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = H.extract(pages, keep=("page_id", "html"), separator="\n\n").collect()
    assert len(rows) == 250
    wrong = [r.page_id for r in rows if r.text != plain_article(r.html)]
    assert wrong == []
