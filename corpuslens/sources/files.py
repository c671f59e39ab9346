"""File sources: directory scans, text, Markdown, DOCX and page-text readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.session import ship
from corpuslens.sources.pdf import pdf_pages

SUFFIXES = {"MARKDOWN": (".md", ".markdown"), "TEXT": (".txt",), "DOCX": (".docx",), "PDF": (".pdf",)}
SECTIONS = "array<struct<content: string, heading: string, page_number: int>>"


def file_type(name: str | Column) -> Column:
    """Type by suffix, whatever its case; null if it isn't supported."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    out = None
    for kind, suffixes in SUFFIXES.items():
        for s in suffixes:
            out = F.when(low.endswith(s), kind) if out is None else out.when(low.endswith(s), kind)
    return out


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]*)$", 1)


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = True, between: tuple[int, int] | None = None) -> DataFrame:
    """Supported files of a folder: document_id, path, file_name, type, size, modified, hash and content, by path.

    Without ``content`` only the listing is read; ``between``: only files modified then, in epoch milliseconds.
    """
    pattern = "*.{" + ",".join(s[1:] for group in SUFFIXES.values() for s in group) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    if between:
        rows = rows.filter(F.col("modificationTime").between(F.timestamp_millis(F.lit(between[0])), F.timestamp_millis(F.lit(between[1]))))
    rows = rows.select(F.sha2("path", 256).alias("document_id"), "path", file_name("path").alias("file_name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), "content")
    rows = rows.withColumn("type", file_type("file_name")).filter(F.col("type").isNotNull())
    if not content:
        return rows.drop("content").orderBy("path")
    return rows.withColumn("hash", F.sha2("content", 256)).orderBy("path")


def text_sections(content: str | Column, fallback: str = "ISO-8859-1") -> Column:
    """One section of a text or Markdown file: UTF-8, or the fallback where the bytes aren't UTF-8."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, fallback))
    text = F.regexp_replace(text, "^﻿", "")
    return F.array(F.struct(text.alias("content"), T.first_heading(text).alias("heading"), F.lit(None).cast("int").alias("page_number")))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, a line each."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{ns}p"):
        parts = [n.text or "" if n.tag == f"{ns}t" else "\t" if n.tag == f"{ns}tab" else "\n" if n.tag == f"{ns}br" else "" for n in p.iter()]
        lines.append("".join(parts))
    return "\n".join(lines)


#: Parsers of types that no built-in function reads: bytes to (content, heading, page) sections.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"DOCX": lambda data: [{"content": docx_text(data), "heading": None, "page_number": None}], "PDF": pdf_pages}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """``sections`` and ``error`` of each scanned file; a file that can't be read, or has no text, is an error row.

    ``parsers`` adds to or replaces those of PARSERS.
    """
    ship(files.sparkSession)
    known = PARSERS | (parsers or {})

    def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for k, c in zip(kind, content, strict=True):
            sections, error = None, None
            if k in known:
                try:
                    sections = [s for s in known[k](bytes(c)) if (s["content"] or "").strip()]
                except Exception as e:  # noqa: BLE001  an error is data here
                    error = f"{type(e).__name__}: {e}"
            elif k not in ("TEXT", "MARKDOWN"):
                error = f"no parser for {k}"
            out.append(sections)
            errors.append(error)
        return pd.DataFrame({"sections": out, "error": errors})

    udf = F.pandas_udf(run, f"sections {SECTIONS}, error string")
    plain = F.col("type").isin("TEXT", "MARKDOWN")
    binary = F.when(~plain, F.col("content"))
    rows = files.withColumn("_p", udf("type", binary))
    rows = rows.withColumn("sections", F.when(plain, text_sections("content")).otherwise(F.col("_p.sections")))
    empty = F.size(F.filter(F.coalesce("sections", F.array().cast(SECTIONS)), lambda s: ~T.is_blank(s["content"]))) == 0
    return rows.withColumn("error", F.coalesce("_p.error", F.when(empty, "no text"))).drop("_p", "content")
