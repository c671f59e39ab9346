"""Main text of web pages by tag-path ratios.

A page's blocks (paragraphs, headings, list items, cells, loose text) are its leaves.  Of each root-to-leaf tag path,
text, link text and punctuation are summed over its leaves: the path's ratios are characters and marks a leaf.  They
are smoothed over neighbouring leaves in page order, fused into one score by the geometric mean, and leaves on paths
whose score reaches a share of the page's mean (weighted by text) are content.  The article is the smallest
element that holds most of the content's weight, an ``article`` or ``main`` element if there is one; every leaf in it
is kept, short ones and headings too, but for paths that hold nothing but short links.

What its markup names as a menu, header, footer, sidebar, notice, advert, form or comment (by tag, role, class or id) is
no leaf.  An article inside such an element is one nevertheless, unless it is named a comment itself.

Defined cases: null and empty pages, and pages without content, give the empty string; character references are decoded
as browsers do, unknown ones stay; white space (any Unicode kind) inside a block becomes one space; a block is what
block-level tags delimit, ``br`` is white space; tags that were never closed end where their parent does; very long
pages are worked on whole, one at a time; repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil
from corpuslens.llm.textkernel import release

#: Share of the page's mean score from which a path is content; share of the content that the article's element holds.
SCORE_SHARE, HOLDS = 0.5, 0.8
#: Mean length up to which a path of links only is a menu.
MENU_CHARS = 40

# Names of the markup language, and names that pages give to what isn't their article.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Text up to the closing tag, whatever it looks like.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")}
#: Elements without a place in the article, whatever they hold.
DROPPED = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "header", "map", "menu", "meter", "nav", "object", "optgroup", "option", "output", "progress",
    "search", "select", "svg", "label", "legend", "fieldset", "video",
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status", "toolbar", "tooltip"}
#: Parts of class names and ids: whole ones, and beginnings.
NAMES = {"ad", "ads", "adv", "adsense", "alert", "banner", "consent", "dialog", "gdpr", "login", "masthead", "menu", "modal", "nav", "navi", "notice", "overlay", "popup", "promo", "related", "replies", "respond", "search", "share", "sharing", "signup", "skip", "social", "subscribe", "toast", "toolbar", "widget"}
BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "header", "navbar", "navigation", "newsletter", "notification", "pagination", "sidebar", "sponsor")
COMMENTS = ("comment", "replies", "respond", "disqus")
#: An element whose class says what it comes with isn't that thing.
WITH = {"with", "has", "no", "without", "not"}
#: A start tag closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?"  # comments and what browsers take for them
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*))>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
MARK = re.compile(r"[.,;:!?…。，！？、]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
ARTICLES = ("article", "main")
#: How an element's text is left out: not, unless an article begins in it, in any case.
SHOWN, UNLESS_ARTICLE, DROP = 0, 1, 2


@dataclass
class Element:
    tag: str
    #: The number of its tag path, and its parent's number.
    path: int
    parent: int
    level: int
    drop: int
    within: bool
    #: A header inside an article: only its headings are leaves.
    heads_only: bool = False


@dataclass
class Page:
    """Elements of block level and leaves of a page; a leaf is (element, text, characters of links)."""

    elements: list[Element] = field(default_factory=lambda: [Element("", 0, -1, 0, SHOWN, False)])
    leaves: list[tuple[int, str, int]] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)


def named(name: str, whole: set[str], beginnings: tuple[str, ...]) -> bool:
    parts = {p.lower() for p in PARTS.findall(name)}
    return not parts & WITH and (bool(parts & whole) or any(p.startswith(beginnings) for p in parts))


def drop_of(tag: str, attributes: str) -> int:
    """Whether an element is left out for its own tag, role, class or id."""
    drop = (UNLESS_ARTICLE if tag == "form" else DROP) if tag in DROPPED else SHOWN
    if drop == DROP or not attributes.strip() or tag in ("html", "body"):
        return drop
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    whole, beginnings = (set(), COMMENTS) if tag in ARTICLES else (NAMES, BEGINNINGS)
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "") or found.get("aria-hidden") == "true"
    if hidden or found.get("role", "").lower() in ROLES or any(named(n, whole, beginnings) for n in names):
        return DROP
    return drop


class Builder:
    """A page from its tags and texts in order, by a stack of the block-level elements that are open."""

    def __init__(self) -> None:
        self.page, self.stack, self.tags, self.open = Page(), [0], [""], Counter()
        self.words: list[str] = []
        self.linked, self.link = 0, False
        #: Inline elements whose text is left out, and where the stack was.
        self.hidden: list[tuple[str, int]] = []

    def flush(self) -> None:
        if self.words:
            block = " ".join("".join(self.words).split())
            if block:
                self.page.leaves.append((self.stack[-1], block, min(self.linked, len(block))))
            self.words.clear()
        self.linked = 0

    def close(self, to: int) -> None:
        """Close the elements from that place of the stack on."""
        self.flush()
        self.link = False
        self.open.subtract(self.tags[to:])
        del self.stack[to:], self.tags[to:]
        while self.hidden and self.hidden[-1][1] > to:
            self.hidden.pop()

    def last(self, wanted: set[str], bounds: set[str]) -> int:
        """The place of the innermost open element that is wanted, inside the innermost bound; 0: there is none."""
        if any(self.open[t] > 0 for t in wanted):
            for i in range(len(self.tags) - 1, 0, -1):
                if self.tags[i] in wanted:
                    return i
                if self.tags[i] in bounds:
                    return 0
        return 0

    def say(self, raw: str) -> None:
        own = self.page.elements[self.stack[-1]]
        if self.hidden or own.drop or own.heads_only and not any(self.open[t] > 0 for t in HEADINGS):
            return
        shown = html.unescape(raw) if "&" in raw else raw
        self.words.append(shown)
        if self.link:
            self.linked += len(shown)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.say(" ")
        elif tag == "a":
            self.link = True
        elif tag in BLOCKS:
            if self.tags[-1] == "p":
                self.close(len(self.tags) - 1)
            if tag in CLOSES and (i := self.last(*CLOSES[tag])):
                self.close(i)
            self.flush()
            if tag != "hr" and not (tag in ("html", "body") and self.open[tag] > 0):
                self.push(tag, attributes)
        elif not (tag in VOID or attributes.endswith("/")):  # inline: only what hides text matters
            if self.hidden or drop_of(tag, attributes):
                self.hidden.append((tag, len(self.stack)))

    def push(self, tag: str, attributes: str) -> None:
        number, page = self.stack[-1], self.page
        parent = page.elements[number]
        own = drop_of(tag, attributes)
        inherited = SHOWN if tag in ARTICLES and parent.drop == UNLESS_ARTICLE else parent.drop
        heads_only = parent.heads_only or tag == "header" and parent.within
        if tag == "header" and parent.within:
            own = SHOWN
        path = page.paths.setdefault((parent.path, tag), len(page.paths) + 1)
        page.elements.append(Element(tag, path, number, parent.level + 1, max(own, inherited), parent.within or tag in ARTICLES, heads_only))
        self.stack.append(len(page.elements) - 1)
        self.tags.append(tag)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag == "br":
            self.say(" ")
        elif tag in BLOCKS and tag not in ("hr", "html", "body"):
            if i := self.last(HEADINGS if tag in HEADINGS else {tag}, {"td", "th", "table"} - {tag}):
                self.close(i)
            else:
                self.flush()
        elif any(t == tag for t, _ in self.hidden):
            while self.hidden.pop()[0] != tag:
                pass


def parse(text: str) -> Page:
    """Elements and leaves of a page."""
    build, at = Builder(), 0
    while (start := text.find("<", at)) >= 0:
        if start > at:
            build.say(text[at:start])
        m = TOKEN.match(text, start)
        if not m:
            build.say("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            build.end(tag)
        elif tag in RAW:
            end = RAW[tag].search(text, at)
            at = end.end() if end else len(text)
        else:
            build.start(tag, m[3])
    build.say(text[at:])
    build.flush()
    return build.page


def smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian window of five leaves; at the ends the window is what there is of it."""
    window = np.exp(-(np.arange(-2.0, 3) ** 2) / 2)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5)
    there = np.lib.stride_tricks.sliding_window_view(np.pad(np.ones(len(x)), 2), 5)
    return near @ window / (there @ window)


def content(page: Page) -> list[str]:
    """The blocks of the main text in page order."""
    if not page.leaves:
        return []
    owner, texts, links = zip(*page.leaves, strict=True)
    chars, links = np.array([len(t) for t in texts], float), np.array(links, float)
    marks = np.array([len(MARK.findall(t)) for t in texts], float)
    _, path = np.unique([page.elements[o].path for o in owner], return_inverse=True)
    leaves = np.bincount(path)
    text_ratio, mark_ratio, link_ratio = (np.bincount(path, x) / leaves for x in (np.maximum(chars - links, 0), marks, links))
    fused = np.sqrt(smooth((text_ratio + 0.01)[path]) * smooth((mark_ratio + 0.01)[path]))
    score = np.bincount(path, fused * chars) / np.bincount(path, chars)
    is_content = (score >= SCORE_SHARE * np.average(fused, weights=chars))[path]
    inside = article(page, owner, np.where(is_content, fused * chars, 0.0))
    menu = (text_ratio <= 0) & (link_ratio <= MENU_CHARS) & (leaves > 1) & (np.bincount(path, marks) == 0)
    kept = [inside[o] and not menu[p] for o, p in zip(owner, path, strict=True)]
    # the page's one title, if it stands before the article's element
    titles = [i for i, o in enumerate(owner) if page.elements[o].tag == "h1"]
    if len(titles) == 1 and not any(kept[: titles[0]]):
        kept[titles[0]] = True
    return [t for t, k in zip(texts, kept, strict=True) if k]


def article(page: Page, owner: tuple[int, ...], weight: np.ndarray) -> list[bool]:
    """Which elements lie in the smallest one that holds most of the weight, or most of its articles' if that is a quarter."""
    elements = page.elements
    held, marked = np.zeros(len(elements)), np.zeros(len(elements))
    np.add.at(held, list(owner), weight)
    np.add.at(marked, list(owner), weight * [elements[o].within for o in owner])
    for e in range(len(elements) - 1, 0, -1):  # parents have smaller numbers
        held[elements[e].parent] += held[e]
        marked[elements[e].parent] += marked[e]
    if 0 < held[0] / 4 <= marked[0]:
        held = marked
    root = max((e for e in range(len(elements)) if held[e] >= HOLDS * held[0]), key=lambda e: elements[e].level)
    # a paragraph or list isn't the article, nor is a part of an article
    while elements[root].parent > 0 and (elements[root].tag not in (*ARTICLES, "section", "div", "body", "center", "td") or elements[elements[root].parent].within):
        root = elements[root].parent
    inside = [False] * len(elements)
    for e in range(root, len(elements)):
        inside[e] = e == root or inside[elements[e].parent]
    return inside


def main_text(page: str | None) -> str:
    """The main text of one page."""
    return "\n\n".join(content(parse(page or "")))


def extract(pages: DataFrame, source: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with a column of the main text of each; a column of that name is replaced."""
    sparkutil.batches(pages.sparkSession, rows=500)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)
        release()

    return pages.withColumn(out, texts(F.col(source)))


def page_texts(pages: DataFrame) -> DataFrame:
    """The rows of the query: (page_id, url, text, n_chars) of every page."""
    found = extract(pages.select("page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
