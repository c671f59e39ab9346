"""Inverted index as tables: postings, document lengths, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T


def postings(rows: DataFrame, fields: dict[str, str], key: str = "chunk_id", positions: bool = False) -> DataFrame:
    """(field, term, key, tf) of the text columns named by ``fields``: field name to column; with ``positions``, which phrases need, also where."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), T.terms(c).alias("terms")) for f, c in fields.items()])
    flat = rows.select(key, F.explode(every).alias("_f"))
    if positions:
        flat = flat.select(key, "_f.field", F.posexplode("_f.terms").alias("_p", "term"))
        return flat.groupBy("field", "term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("_p")).alias("positions"))
    flat = flat.select(key, "_f.field", F.explode("_f.terms").alias("term"))
    return flat.groupBy("field", "term", key).agg(F.count("*").alias("tf"))


# fixed values: the line that opens or closes a block of code, with its language
FENCE = r"^\s*```\s*([A-Za-z0-9_+.#-]*)\s*$"


def split_code(content: str | Column) -> Column:
    """Struct of the ``prose`` outside fenced blocks, the ``code`` inside (fence lines with it) and the ``languages``.

    A fence that isn't closed runs to the end.  Lines are folded one after the other, as a chunk has few of them.
    """
    c = F.col(content) if isinstance(content, str) else content
    lines = F.split(T.unify_newlines(F.coalesce(c, F.lit(""))), "\n", -1)
    nothing = F.struct(F.lit(False).alias("inside"), F.lit("").alias("prose"), F.lit("").alias("code"), F.lit("").alias("languages"))

    def step(s: Column, line: Column) -> Column:
        fence, row = line.rlike(FENCE), F.concat(line, F.lit("\n"))
        opens = fence & ~s["inside"]
        language = F.concat(F.regexp_extract(line, FENCE, 1), F.lit("\n"))
        return F.struct(
            (s["inside"] != fence).alias("inside"), F.when(fence | s["inside"], s["prose"]).otherwise(F.concat(s["prose"], row)).alias("prose"),
            F.when(fence | s["inside"], F.concat(s["code"], row)).otherwise(s["code"]).alias("code"),
            F.when(opens, F.concat(s["languages"], language)).otherwise(s["languages"]).alias("languages"),
        )

    return F.aggregate(lines, nothing, step)


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the texts of their index fields: ``prose`` and ``code``.

    ``chunks`` has file_name, heading and content.  File name, heading and the text outside code are prose; code is
    the fenced blocks with their languages, the identifiers of the blocks with their parts, and words that mark diagrams.
    """
    rows = chunks.withColumn("_s", split_code("content"))
    some = lambda c: F.when(~T.is_blank(c), c)
    prose = F.concat_ws("\n", some(F.col("file_name")), some(F.col("heading")), some(F.col("_s.prose")))
    code = F.concat_ws("\n", some(F.col("_s.languages")), some(F.col("_s.code")), some(F.array_join(T.code_terms(F.col("_s.code")), "\n")))
    return rows.withColumns({"prose": prose, "code": code}).drop("_s")


#: The fields of the chunk index and the columns that :func:`chunk_texts` gives for them.
CHUNK_FIELDS = {"content": "prose", "codeContent": "code", "heading": "heading", "fileName": "file_name"}


def rebuild(records: DataFrame, chunks: DataFrame, chosen: Column, at: Column, key: str = "doc_id") -> DataFrame:
    """Records after their index entries were made again: ``indexed_at`` and ``indexed_chunks``, and ``rebuilt`` (null if not chosen).

    Only parsed documents that are ``chosen`` are made again: all, some ids, or those that aren't indexed yet.  A
    document with a chunk that has an ``error`` fails by itself: its ``indexed_at`` is cleared, the others go on.
    """
    per = chunks.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.count("error").alias("_bad"))
    rows = records.join(per, F.col(key) == F.col("_k"), "left").withColumn("_on", F.coalesce((F.col("status") == "PARSED") & chosen, F.lit(False)))
    good = F.coalesce(F.col("_bad"), F.lit(0)) == 0
    return rows.select(
        *[F.col(c) for c in records.columns if c != "indexed_at"], F.when(~F.col("_on"), F.col("indexed_at")).when(good, at).alias("indexed_at"),
        F.when(F.col("_on") & good, F.coalesce("_n", F.lit(0))).alias("indexed_chunks"), F.when(F.col("_on"), good).alias("rebuilt"),
    )


def doc_stats(posts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(field, key, dl): how many terms a field has."""
    return posts.groupBy("field", key).agg(F.sum("tf").alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(field, term, df): how many rows have a term."""
    return posts.groupBy("field", "term").agg(F.count("*").alias("df"))


def collection_stats(posts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(field, n, avgdl) over the rows that have the field."""
    return field_stats(doc_stats(posts, key))


def field_stats(lengths: DataFrame) -> DataFrame:
    """The same of (field, key, dl)."""
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def replace_documents(posts: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index after the documents of ``new`` were put in place of their older entries."""
    return posts.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(posts: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return posts.join(gone.select(key).distinct(), key, "left_anti")
