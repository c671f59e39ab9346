"""Benchmark decontamination by winnowing.

Of every ``WINNOW`` consecutive k-gram hashes of a text the smallest one (the leftmost on ties) is kept as a
fingerprint, so any span of ``K + WINNOW - 1`` = 13 words that a document and a benchmark item share leaves the
same fingerprint in both, at the same place of the span.  A fingerprint that meets one of the benchmark is extended to
every window of 13 words around it, and those windows are compared, word by word, with the windows of the items.
Items shorter than 13 words, for which no fingerprint is guaranteed, are looked up by the hash of their whole word
sequence, in one pass for all lengths.  What is gathered for a text is the places of its own words, never pairs of
places in a text and an item: windows that the same items have share one set of items, and a text's sets, not its
places, meet their items.  So repetitive texts, and passages that many items share, cost no more than their words
and the items that are found.

Defined cases: a null or empty text has no words, and so no hits; a null doc_id is a document like others; repeated
rows give repeated results; repeated item rows count once, and rows of one item_id with different texts count as
that one item; items without words never hit; a null item_id counts as an item named by the empty string; empty
tables give empty or hit-free results; other columns are ignored (:func:`remove_contaminated` keeps them).
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil

#: Words of a window, of a fingerprint's k-gram, and k-grams of which the smallest is kept.
WINDOW, K = 13, 5
WINNOW = WINDOW - K + 1
#: A document is worked on in pieces of so many words (plus the overlap of a window).
PIECE = 1 << 20
#: Bits of a packed fingerprint that hold its place in a piece.
_PLACE_BITS = 21
CONTAMINATED_SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Lower-cased (A-Z only) words of a text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def _folded_hashes(text: str) -> Column:
    """Hashes of the words of a text in full lower case: equal wherever :func:`words` are, at the same places.

    Lower-casing never makes or removes a separator, and it costs far less than replacing A-Z alone; fingerprints
    only propose, and what they propose is compared by :func:`words`.  Of all characters only the capital sigma is
    lower-cased by what stands beyond its word, to a final one or not; so final sigmas are folded into the other form.
    """
    w = F.array_remove(F.split(F.replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("ς"), F.lit("σ")), _SEPARATORS), "")
    return F.transform(w, lambda x: F.xxhash64(x))


def count_words(text: str) -> Column:
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.array_remove(parts, ""))


def _sliding(rows: DataFrame, column: str, width: int, join, *keep: str) -> DataFrame:
    """``column`` folded over each window of ``width`` neighbours, by doubling: each step is one pass over the array.

    The last ``width - 1`` values cover what is left of the array.
    """
    rows = rows.select(*keep, F.col(column).alias("_one"), F.col(column).alias("_acc"))
    done, n = 1, F.size("_one")
    for bit in bin(width)[3:]:
        rows = rows.select(*keep, "_one", F.zip_with("_acc", F.slice("_acc", done + 1, n), join).alias("_acc"))
        done *= 2
        if bit == "1":
            rows = rows.select(*keep, "_one", F.zip_with("_acc", F.slice("_one", done + 1, n), join).alias("_acc"))
            done += 1
    return rows.select(*keep, F.col("_acc").alias(column))


def fingerprints(rows: DataFrame, h: str, *keep: str) -> DataFrame:
    """``keep``, ``place`` and ``hash`` of every winnowed fingerprint of the word hashes ``h``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0)), F.lit(PIECE))
    piece = F.when(F.size(h) <= PIECE, F.array(F.struct(F.lit(0).alias("base"), F.col(h).alias("h")))).otherwise(
        F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice(F.col(h), s + 1, PIECE + WINDOW - 1).alias("h")))
    )
    rows = rows.select(*keep, F.explode(piece).alias("_p")).select(*keep, F.col("_p.base").alias("_base"), F.col("_p.h").alias("_h"))
    every = [*keep, "_base"]
    rows = _sliding(rows, "_h", K, lambda a, b: F.xxhash64(a, b), *every)
    # hash above, place below: the smallest packed value is the smallest hash, leftmost on ties
    low = (1 << _PLACE_BITS) - 1
    rows = rows.select(*every, F.transform("_h", lambda v, i: v.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))).alias("_h"))
    rows = _sliding(rows, "_h", WINNOW, lambda a, b: F.least(a, b), *every)
    kept = F.array_distinct(F.slice("_h", 1, F.greatest(F.size("_h") - WINDOW + 1, F.lit(0))))
    rows = rows.select(*every, F.explode(kept).alias("_f"))
    place = F.col("_base") + F.col("_f").bitwiseAND(F.lit(low)).cast("int")
    return rows.select(*keep, place.alias("place"), F.shiftright("_f", _PLACE_BITS).alias("hash"))


def _short(rows: DataFrame, h: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep``, ``place``, ``k`` and ``hash`` of every window of each of the given lengths."""
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: _whole_hash(F.slice(F.col(h), i, k)))
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.size(h) >= k, grams(k)).alias("hs")) for k in lengths])
    return rows.select(*keep, F.explode(every).alias("_s")).select(*keep, F.col("_s.k").alias("k"), F.posexplode("_s.hs").alias("place", "hash"))


def _whole_hash(h: Column) -> Column:
    return F.xxhash64(h, F.size(h))


def _window(w: str, start: Column, k: Column) -> Column:
    """The words of a window as one text; no word holds a blank."""
    return F.array_join(F.slice(F.col(w), start + 1, k), " ")


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, ``text_key``, ``n_hit`` and ``items`` of each distinct row of ``docs`` that has a hit."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("iw"), _folded_hashes("text").alias("h"))
    items = sparkutil.table(items.filter(F.size("iw") > 0).distinct(), "items")
    short = items.filter(F.size("iw") < WINDOW)
    lengths = sorted(r["n"] for r in short.select(F.size("iw").alias("n")).distinct().collect())  # 12 at most
    marks = fingerprints(items, "h", "item_id").select("hash").unionByName(short.select(_whole_hash(F.col("h")).alias("hash")))
    marks = sparkutil.small(sparkutil.table(marks.distinct(), "marks"))
    # an item shorter than a window has one window: itself
    k = F.least(F.size("iw"), F.lit(WINDOW))
    windows = items.select("item_id", "iw", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("iw") - k)).alias("start"))
    windows = sparkutil.table(windows.select("item_id", _window("iw", F.col("start"), F.col("k")).alias("window")).distinct(), "windows")
    # windows that the same items have share a set of items, told by hashes that don't depend on an order
    same = [F.bit_xor(F.xxhash64("item_id", F.lit(salt))) for salt in ("a", "b")]
    sets = windows.groupBy("window").agg(F.concat_ws("-", F.count("*"), *same).alias("items_of"))
    sets = sparkutil.small(sparkutil.table(sets, "window-sets"))
    members = sets.groupBy("items_of").agg(F.min("window").alias("window")).join(windows, "window").select("items_of", "item_id")
    members = sparkutil.small(sparkutil.table(members, "set-members"))

    key = ["doc_id", "text_key"]
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _folded_hashes("text").alias("h"))
    around = [F.greatest(F.col("place") - (WINNOW - 1), F.lit(0)).alias("first"), F.col("place").alias("last"), F.lit(WINDOW).alias("k")]
    met = fingerprints(base, "h", *key).join(marks, "hash", "left_semi").select(*key, *around)
    if lengths:
        own = _short(base, "h", lengths, *key).join(marks, "hash", "left_semi")
        met = met.unionByName(own.select(*key, F.col("place").alias("first"), F.col("place").alias("last"), "k"))
    # places of the text itself, as many as it has words at most
    met = sparkutil.table(met.groupBy(*key).agg(F.collect_set(F.struct("first", "last", "k")).alias("met")), "candidates")
    met = sparkutil.small(met)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = rows.join(met, rows["doc_id"].eqNullSafe(met["doc_id"]) & (rows["text_key"] == met["text_key"])).select(rows["doc_id"], rows["text_key"], "met", words("text").alias("w"))
    at = lambda m: F.transform(F.filter(F.sequence(m["first"], m["last"]), lambda i: i + m["k"] <= F.size("w")), lambda i: F.struct(i.alias("start"), m["k"].alias("k")))
    rows = rows.select(*key, "w", F.explode(F.array_distinct(F.flatten(F.transform("met", at)))).alias("_a"))
    rows = rows.select(*key, "_a.start", "_a.k", _window("w", F.col("_a.start"), F.col("_a.k")).alias("window"))
    # a row for each place of the text, however many items have its window
    hits = sparkutil.table(rows.join(sets, "window").select(*key, "start", "k", "items_of").distinct(), "window-hits")

    # words under any window: each window adds what the ones before it don't reach
    end = F.col("start") + F.col("k")
    before = F.max(end).over(Window.partitionBy(*key).orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1))
    added = hits.select(*key, "start", "k").select(*key, F.greatest(end - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)).alias("added"))
    counted = added.groupBy(*key).agg(F.sum("added").alias("n_hit")).withColumn("items", F.lit(None).cast("array<string>"))
    found = hits.select(*key, "items_of").distinct().join(members, "items_of")
    named = found.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("n_hit", F.lit(None).cast("long"))
    return counted.unionByName(named).groupBy(*key).agg(F.max("n_hit").alias("n_hit"), F.first("items", ignorenulls=True).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the contract for each row of ``docs``."""
    hits = sparkutil.table(find_hits(docs, benchmark), "hits")
    few = sparkutil.small(hits)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), count_words("text").cast("long").alias("n_words"))
    joined = rows.join(few, rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows["text_key"] == few["text_key"]), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        rows["doc_id"], "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (CONTAMINATED_SHARE * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    hits = find_hits(docs, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), "n_hit")
    few = sparkutil.table(hits, "hits")
    few = sparkutil.small(few)
    # only rows with hits can be contaminated; their words are counted again
    same = docs["doc_id"].eqNullSafe(few["_hit_id"]) & (F.xxhash64(docs["text"]) == few["_hit_key"]) & _contaminated(few["n_hit"], F.size(words(docs["text"])))
    return docs.join(few, same, "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)
), m AS (SELECT r, dw.k, p, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
