"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as the regular expressions of the JVM see it.
WS = " \t\n\r\x0b\f"
CHUNK_CHARS, OVERLAP_CHARS = 1800, 200
PREVIEW_CHARS, TITLE_CHARS = 260, 18


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trim_ws(x: str | Column) -> Column:
    return F.btrim(_c(x), F.lit(WS))


def collapse_ws(x: str | Column) -> Column:
    return trim_ws(F.regexp_replace(_c(x), r"\s+", " "))


def is_blank(x: str | Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(trim_ws(x), F.lit("")) == ""


def unify_newlines(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def clean_prose(x: str | Column) -> Column:
    """Clean text without fences: line ends, tabs, runs of blanks and of blank lines; then trim."""
    x = F.regexp_replace(unify_newlines(x), r"[\t\x0B\f]+", " ")
    return trim_ws(F.regexp_replace(F.regexp_replace(x, " {2,}", " "), r"\n{3,}", "\n\n"))


def ellipsis(x: str | Column, n: int) -> Column:
    x = _c(x)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n), F.lit("...")))


def preview(x: str | Column) -> Column:
    return ellipsis(collapse_ws(x), PREVIEW_CHARS)


def title(x: str | Column) -> Column:
    return ellipsis(collapse_ws(x), TITLE_CHARS)


def first_heading(x: str | Column) -> Column:
    """The first line that starts with ``#`` (trimmed), without its hashes, that isn't blank then; else null."""
    lines = F.transform(F.split(_c(x), "\n"), lambda v: trim_ws(v))
    heads = F.transform(F.filter(lines, lambda v: v.startswith("#")), lambda v: trim_ws(F.regexp_replace(v, "^#+", "")))
    return F.get(F.filter(heads, lambda v: v != ""), F.lit(0))


def chunk_tokens(x: str | Column) -> Column:
    """Token estimate of a chunk: a quarter of its characters, rounded up."""
    return F.ceil(F.length(_c(x)) / 4).cast("long")


def mixed_tokens(x: str | Column) -> Column:
    """Token estimate of a message: ASCII runs by quarters, other blanks a quarter, any other character one.

    A blank text counts 0, any other 1 at least.
    """
    x = F.coalesce(_c(x), F.lit(""))
    runs = F.aggregate(F.regexp_extract_all(x, F.lit(r"[\x00-\x7F]+"), F.lit(0)), F.lit(0).cast("long"), lambda a, r: a + F.ceil(F.length(r) / 4).cast("long"))
    wide = F.regexp_replace(x, r"[\x00-\x7F]+", "")
    blanks = F.length(wide) - F.length(F.regexp_replace(wide, "[\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]", ""))
    total = runs + F.length(wide) - blanks + blanks * 0.25
    return F.when(is_blank(x), F.lit(0)).otherwise(F.greatest(F.ceil(total), F.lit(1))).cast("long")


def terms(x: str | Column) -> Column:
    """Search terms: lower-case runs of letters, digits and underscores; Han characters stand alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(r"[\p{L}\p{Nd}_&&[^\p{IsHan}]]+|\p{IsHan}"), F.lit(0))


# fixed values: what an identifier is, and the words that mark diagrams
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.:/#\\-][A-Za-z0-9_$]+)*"
DIAGRAM_WORDS = [
    "graph",
    "flowchart",
    "sequenceDiagram",
    "classDiagram",
    "stateDiagram",
    "erDiagram",
    "journey",
    "gantt",
    "pie",
    "mindmap",
    "timeline",
    "participant",
    "actor",
    "subgraph",
    "startuml",
    "enduml",
]


def identifiers(x: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def identifier_parts(x: str | Column) -> Column:
    """Parts of one identifier: split at separators, at lower-to-upper steps and before the last capital of a run."""
    x = F.regexp_replace(_c(x), r"[\\.:#/_-]", " ")
    x = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(x, r"\s+"), lambda v: v != "")


def diagram_words(x: str | Column) -> Column:
    pattern = rf"(?i)(?<![A-Za-z0-9_])({'|'.join(DIAGRAM_WORDS)})(?![A-Za-z0-9_])"
    return F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(1)), lambda v: F.lower(v))


def code_terms(x: str | Column) -> Column:
    """What a code block adds to the code field: identifiers, their parts, diagram words; repeats are kept."""
    ids = identifiers(x)
    parts = F.flatten(F.transform(ids, lambda v: F.concat(F.array(v), identifier_parts(v))))
    return F.concat(parts, diagram_words(x))


def content_hash(x: str | Column) -> Column:
    return F.sha2(_c(x), 256)


def chunk_id(document_id: str | Column, index: str | Column) -> Column:
    return F.sha2(F.concat_ws(":", _c(document_id), _c(index).cast("string")), 256)


def stable_id(seed: str | Column) -> Column:
    """Version-3 UUID of a text, without a namespace."""
    h = F.md5(_c(seed))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"),
        variant.substr(F.pmod(nibble, F.lit(4)) + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def web_source_id(url: str | Column) -> Column:
    return F.concat(F.lit("web:"), F.substring(F.sha2(_c(url), 256), 1, 24))


def search_query(x: str | Column) -> Column:
    """A web query: white space collapsed, at most 300 characters."""
    return F.substring(collapse_ws(x), 1, 300)


def byte_size(x: str | Column) -> Column:
    """B, KB or MB with one decimal place from KB on."""
    x = _c(x)
    return (
        F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B")))
        .when(x < 1024 * 1024, F.concat(F.format_string("%.1f", x / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", x / 1024 / 1024), F.lit(" MB")))
    )


# fixed values: what marks and makes up a version in a file name, and names too general to be a family
VERSION_TOKEN = r"(?<![A-Za-z0-9_])(v\d+(?:\.\d+)*|final|draft)(?![A-Za-z0-9_])"
VERSION_DATE = r"(?<![A-Za-z0-9_])\d{4}(?:\d{2})?(?:\d{2})?(?![A-Za-z0-9_])"
VERSION_DATE_MARK = r"(?<![A-Za-z0-9_])\d{4}(?:[-_.]?\d{2})?(?:[-_.]?\d{2})?(?![A-Za-z0-9_])"
VERSION_SUFFIXES = "最新版|新版|旧版|修订版|终稿|草稿"
GENERIC_NAMES = ["readme", "index", "toc", "catalog", "summary", "overview", "contents", "目录", "内容", "导航", "说明", "简介"]


def strip_extension(name: str | Column) -> Column:
    n = trim_ws(F.coalesce(_c(name), F.lit("")))
    return F.when(n.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(n, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(n)


def version_family(name: str | Column) -> Column:
    """Key of the files that look like versions of one document; null without a sign of a version in the name."""
    return let(strip_extension(name), _version_family)


def _version_family(base: Column) -> Column:
    marked = F.lower(base).rlike(f"{VERSION_TOKEN}|{VERSION_SUFFIXES}|{VERSION_DATE_MARK}")
    key = F.translate(F.lower(base), "（）()[]_-.", " " * 9)
    for pattern in (VERSION_TOKEN, VERSION_DATE, f"({VERSION_SUFFIXES})$"):
        key = F.regexp_replace(key, pattern, " ")
    return let(collapse_ws(key), lambda k: F.when(marked & (F.length(k) >= 2) & ~k.isin(*GENERIC_NAMES), k))
