"""Main texts of pages: whole tables against the text between the article's tags, odd markup against what browsers show."""

import html
import random
import re

import pytest

from corpuslens.llm import html_text
from corpuslens.llm.html_text import main_text

TRUTH = "/root/testdata/sf0.01"
BODY = "<p>One sentence, and another one. It has marks; it is prose.</p><p>Second paragraph here, with words. And more, as ever.</p>"
SHOWN = "One sentence, and another one. It has marks; it is prose.\n\nSecond paragraph here, with words. And more, as ever."


def between(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_every_page_of_a_table(spark):
    from corpuslens.llm import registry

    pages = {r["page_id"]: r["html"] for r in registry.read(spark, TRUTH, "pages").collect()}
    got = registry.op11_html_text(spark, TRUTH).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == between(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


NOISE = [
    "<nav><a href=/>Home</a> <a href=/b>About us, and more. Really.</a></nav>", "<header><h1>Site name</h1><p>Slogan, of the site.</p></header>", "<footer>Copyright, all rights reserved. Everywhere.</footer>",
    "<aside>Sidebar text, with a sentence. And another.</aside>", '<div class="cookie-banner"><p>We use cookies, as you know. Accept.</p></div>', '<div id="sidebar-left">Some, long, text. In it.</div>',
    '<div class="ad">Buy this, now. It is cheap.</div>', "<form><p>Your name, please.</p><input name=a><select><option>One<option>Two</select></form>", "<script>if (a<b) document.write('<p>no</p>')</script>",
    "<style>p > a { color: red }</style>", '<section class="comments"><h2>2 comments</h2><ol><li><article><p>I agree, of course. Nice text.</p></article></li></ol></section>',
    '<div id="comments"><div class="comment-body"><p>First! And, more.</p></div></div>', "<noscript><p>Enable scripts, please.</p></noscript>", '<p class="notice">This page, is old.</p>', "<!-- <p>hidden</p> -->",
    '<div role="navigation"><ul><li>Menu one<li>Menu two</ul></div>', "<p hidden>Not shown, at all.</p>", "<button>Press</button>", '<ul class="breadcrumbs"><li><a href=/x>Up</a></li></ul>', '<div style="display: none">Unseen, it is.</div>',
]


@pytest.mark.parametrize("noise", NOISE)
def test_noise_is_left_out(noise):
    for frame in ("<article>{}</article>", "<main>{}</main>", "<div class=layout-with-sidebar>{}</div>", "{}"):
        content = frame.format(f"<h1>Title</h1>{BODY}")
        assert main_text(f"<html><body>{noise}{content}</body></html>") == f"Title\n\n{SHOWN}"
        assert main_text(f"<html><body>{content}{noise}{noise}</body></html>") == f"Title\n\n{SHOWN}"
    inside = f"<body><article><h1>Title</h1>{noise if '<header' not in noise else ''}{BODY}{noise if '<header' not in noise else ''}</article></body>"
    assert main_text(inside) == f"Title\n\n{SHOWN}"


def test_all_of_an_article_is_kept():
    page = f"<article><header><h1>Title</h1><p>By somebody</p></header>{BODY}<h2>Part</h2><ul><li>one<li>two <b>bold</b></ul><table><tr><td>a<td>b</table><blockquote>Said.</blockquote><pre>x  =\n 1</pre><p>Be.</p></article>"
    assert main_text(page).split("\n\n") == ["Title", *SHOWN.split("\n\n"), "Part", "one", "two bold", "a", "b", "Said.", "x = 1", "Be."]
    assert main_text("<body><div class=ad>" + "Long advert, it is. " * 50 + "</div><article><p>Be.</article>") == "Be."


def test_article_in_a_form():
    assert main_text(f"<body><form id=aspnet><div><nav>Menu</nav><article>{BODY}</article></div></form>") == SHOWN


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>a &amp; b &lt;c&gt; &#65;&#x42; &copy &nope; &am", "a & b <c> AB © &nope; &am"), ("<p>a<b>b<i>c</b>d</i>", "abcd"), ("<p>a\n\t b &nbsp; c", "a b c"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<p title='x > y' data-a=\"it's\">a", "a"), ("<p title=it's>a</p><p title=it's>b</p>", "a\n\nb"), ("<p>1 < 2 <3 a<b", "1 < 2 <3 a"), ("<p>a<br/>b<br>c", "a b c"), ("a<!-->b<!--c", "ab"), ("<P>A</P ><p/>b", "A\n\nb"),
        ("<p>x</div></span></p>y", "x\n\ny"), ("<p><a href=/>All of this is one link, a long one. It stays.</a>", "All of this is one link, a long one. It stays."), ("<dl><dt>t<dd>d</dl>", "t\n\nd"), ("<p>a<wbr>b<img src=x>c<svg><text>z</text></svg>", "abc"),
        ("<textarea><p>q</textarea><p>e", "e"), ("<script>x", ""), ("", ""), (" \n ", ""), ("<p>日本、語。<p>é", "日本、語。\n\né"),
    ],
)
def test_markup(inner, want):
    assert main_text(f"<html><body><article>{inner}") == want


def test_by_ratios_alone():
    """Without any telling names: a link list, short labels and a line of rights around prose."""
    prose = "".join(f"<p>Sentence {i}, which is prose. It goes on, and on; it ends.</p>" for i in range(6))
    page = f"<body><div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Mail</a></div></div><div>{prose}</div><table><tr><td>Login<td>Help</table></body>"
    assert main_text(page) == "\n\n".join(f"Sentence {i}, which is prose. It goes on, and on; it ends." for i in range(6))


def test_hostile_sizes():
    assert main_text("<div>" * 20_000 + "deep, text.") == "deep, text."
    assert main_text("<p>" + "a &amp; " * 200_000) == ("a & " * 200_000).strip()
    assert len(main_text("<article>" + "<p>Words, here.</p>" * 50_000).split("\n\n")) == 50_000
    assert main_text("<" * 100_000) == "<" * 100_000
    assert main_text("</div>" * 50_000 + "<p>x") == "x"


def test_any_bytes_are_survived():
    rng = random.Random(4)
    pieces = ["<", ">", "<p", "</p>", "<div class=", '"', "'", "=", "&", "&#", "&#x110000;", "<!--", "-->", "<script>", "</script", "a", " ", "<table>", "<tr>", "</td>", "<form>", "</form>", "<article>", "\0", "é", "<a href=", "/>", "<h1>", "</h2>", "<svg>", "<li>"]
    for _ in range(1500):
        assert "\n\n\n" not in main_text("".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))))


def test_odd_rows(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", "", "t", 5), (None, None, f"<article>{BODY}</article>", None, None), (2, "v", "<p>x", "t", 1), (2, "v", "<p>x", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = [tuple(r) for r in html_text.page_texts(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", "", 0)] * 2 + [(None, None, SHOWN, len(SHOWN)), (2, "v", "x", 1), (2, "v", "x", 1)], key=repr)
    kept = html_text.extract(pages)
    assert kept.columns == [*pages.columns, "main_text"] and {r["text"] for r in kept.collect()} == {"t", None}
    assert html_text.page_texts(pages.limit(0)).count() == 0
