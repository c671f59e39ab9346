"""Chunking: sliding windows of plain text, and packing of text with fenced blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

_FENCE = re.compile(r"\s*```.*", re.ASCII)
# fixed values: what the first line of a diagram begins with
_DIAGRAM = re.compile(r"\s*(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram(-v2)?|erDiagram|journey|gantt|pie|mindmap|timeline|@startuml)\b.*", re.ASCII)
_TRIM = "".join(map(chr, range(33)))


def windows(text: str | Column, width: int = T.CHUNK_CHARS, overlap: int = T.OVERLAP_CHARS) -> Column:
    """Array of overlapping windows of a text, trimmed, without blank ones; built-in functions only."""
    step = width - overlap

    def cut(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(c) - width) / step), F.lit(0)).cast("int"))
        return F.filter(F.transform(starts, lambda i: T.trim_ws(c.substr(i * step + 1, F.lit(width)))), lambda w: w != "")

    # bound by a lambda, so that an expression is evaluated once and not for every window
    return T.let(F.col(text) if isinstance(text, str) else text, cut)


def chunk_plain(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of unfenced text: key, chunk_index, content, token_count."""
    out = docs.select(key, windows(T.clean_prose(text)).alias("_w"))
    # outer, as the optimizer would else clean and cut a text once more to filter by the number of its windows
    out = out.select(key, F.posexplode_outer("_w").alias("chunk_index", "content")).filter(F.col("content").isNotNull())
    return out.withColumn("token_count", T.chunk_tokens("content"))


def _blocks(text: str) -> list[tuple[str, bool]]:
    """(text, fenced) of each stretch between fence lines; an unclosed fence runs to the end."""
    out: list[tuple[str, bool]] = []
    lines: list[str] = []
    fenced = False

    def close(kind: bool) -> None:
        if lines:
            out.append(("".join(f"{x}\n" for x in lines), kind))
            lines.clear()

    for line in text.split("\n"):
        mark = _FENCE.fullmatch(line) is not None
        if mark and not fenced:
            close(False)
        lines.append(line)
        if mark:
            if fenced:
                close(True)
            fenced = not fenced
    close(fenced)
    return out


def clean_text(text: str) -> str:
    """Prose cleaned, fenced blocks as they are."""
    parts = []
    for block, fenced in _blocks(text.replace("\r\n", "\n").replace("\r", "\n")):
        if not fenced:
            block = re.sub(r"\n{3,}", "\n\n", re.sub(" {2,}", " ", re.sub(r"[\t\v\f]+", " ", block)))
        parts.append(block)
    return "".join(parts).strip(_TRIM)


def _fenced_pieces(block: str, width: int) -> list[str]:
    """Cut a long fenced block; each piece has the opening line, a diagram's header, and a closing fence."""
    lines = block.split("\n")
    head = lines[:2] if len(lines) > 1 and _DIAGRAM.fullmatch(lines[1]) else lines[:1]
    closed = len(lines) > 1 and _FENCE.fullmatch(lines[-1]) is not None
    close = lines[-1] if closed else "```"
    body = lines[len(head) : -1] if closed else lines[len(head) :]
    fixed = sum(len(x) + 1 for x in head)
    out: list[str] = []
    held: list[str] = []
    size = fixed
    for line in body:
        if held and size + len(line) + len(close) + 2 > width:
            out.append("\n".join([*head, *held, close]))
            held, size = [], fixed
        held.append(line)
        size += len(line) + 1
    if held:
        out.append("\n".join([*head, *held, close]))
    return out


def chunk_section(text: str, width: int = T.CHUNK_CHARS, overlap: int = T.OVERLAP_CHARS) -> list[str]:
    """Chunks of one cleaned section: blocks are packed up to ``width``, longer ones are cut on their own."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append("\n".join(held))
            held.clear()

    for block, fenced in _blocks(text):
        block = block.strip(_TRIM)
        if not block:
            continue
        if len(block) > width:
            flush()
            if fenced:
                out += _fenced_pieces(block, width)
            else:
                n = max(0, -(-(len(block) - width) // (width - overlap))) + 1
                out += [block[i * (width - overlap) :][:width] for i in range(n)]
            continue
        if held and sum(len(h) + 1 for h in held) + len(block) > width:
            flush()
        held.append(block)
    flush()
    return [c for c in (x.strip(_TRIM) for x in out) if c]


def clean_fenced(text: str | Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else clean_text(v))

    return F.pandas_udf(run, "string")(text)


def _chunk_sections(items) -> list[dict]:
    found = []
    for s in items if items is not None else ():
        for c in chunk_section(clean_text(s["content"] or "")):
            found.append({"content": c, "page_number": s["page_number"], "heading": s["heading"]})
    return found


def chunk_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of ``sections`` (array of content, heading, page_number), numbered through each document."""

    def run(sections: pd.Series) -> pd.Series:
        return sections.map(_chunk_sections)

    cut = F.pandas_udf(run, "array<struct<content: string, page_number: int, heading: string>>")
    out = docs.select(key, F.posexplode(cut("sections")).alias("chunk_index", "_c"))
    return out.select(key, "chunk_index", "_c.content", "_c.page_number", "_c.heading", T.chunk_tokens("_c.content").alias("token_count"))
