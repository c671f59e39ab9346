"""Spelling variant grouping by letter-parity bitmask bands.

The mask of a word has a bit for each letter (letters may share one), set if the letter occurs an odd number of times.
One inserted or deleted letter flips one bit, one replaced letter two or none, so of the three bands of 21 bits that
a mask is split into, two near words have one that is equal.  Words meet where a band is equal, under a length filter
(equal lengths, or one apart), and an edit distance verifies what meets.

A parity band alone has few values, so buckets would grow with the square of the vocabulary.  Hence words must also
agree in two of three thirds, which two near words always do: an edit touches only one third of the shorter word.  A
bucket of more than ``SPLIT`` words (long words that differ only within one third) is divided further by what a word
is with one of its letters left out: at most an alphabet of words share that, and near words always do.  So no pair
is lost, at any size, and no bucket is paired with itself as a whole unless it is small.  A pair that meets in several
buckets counts in the first one that its two words have in common, which they tell themselves.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text; repeated rows are
occurrences like others; of near words with equal counts the smallest in code-point order is the form; very long
words and texts are words and texts like others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
BANDS, BAND_BITS = 3, 21
#: Words of a bucket up to which they are compared with each other.
SPLIT = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run) of each maximal run of at least so many letters, A-Z lower-cased, once for each occurrence."""
    # a shorter run has no long enough part, so what the pattern finds are whole maximal runs
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    return docs.select("doc_id", found.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def count_words(words: DataFrame, least: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words (column ``word``, a row for each occurrence) that are long and frequent enough."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _mask(word: Column) -> Column:
    def flip(mask, letter):
        code = F.ascii(letter)
        bit = (code % BANDS) * BAND_BITS + F.floor(code / BANDS).cast("int") % BAND_BITS
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def _band(mask: Column, b: int) -> Column:
    return F.shiftright(mask, b * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _thirds(word: Column, base: Column) -> list[Column]:
    """What stays of ``word`` when the last, the first, or the middle third may be edited, for a shorter word of ``base`` letters."""
    a = F.floor(base / 3).cast("int")
    head, tail = word.substr(F.lit(1), base - a), F.right(word, base - a)
    return [head, tail, F.concat(word.substr(F.lit(1), a), F.lit(" "), F.right(word, a))]


def _keys(words: DataFrame) -> DataFrame:
    """A row for each key of a word, as one of the ``base`` length and as one that is a letter longer."""
    sized = words.select("word", "n", F.length("word").alias("len"), _mask(F.col("word")).alias("mask"))
    sized = sized.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    base = F.col("len") - F.col("longer").cast("int")
    spots = [(k, b, part) for k, part in enumerate(_thirds(F.col("word"), base)) for b in range(BANDS)]
    key = [F.struct(F.lit(k * BANDS + b).alias("spot"), F.xxhash64(F.lit(k * BANDS + b), base, _band(F.col("mask"), b), part).alias("key")) for k, b, part in spots]
    return sized.select("word", "n", "mask", "longer", F.inline(F.array(*key)))


def _first_spot(base: Column) -> Column:
    """The first key that both words of a pair (a, b) have."""
    same = [x.eqNullSafe(y) for x, y in zip(_thirds(F.col("a.word"), base), _thirds(F.col("b.word"), base), strict=True)]
    band = F.coalesce(*[F.when(_band(F.col("a.mask"), b) == _band(F.col("b.mask"), b), b) for b in range(BANDS)])
    return F.coalesce(*[F.when(s, k * BANDS) for k, s in enumerate(same)]) + band


def _without_one(word: Column, placed: bool) -> Column:
    """Hashes of ``word`` with each of its letters left out; ``placed``: with the letter's place."""
    rest = lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.xxhash64(i if placed else F.lit(0), rest(i)))


def near_pairs(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, n, near, near_n) of every two words that are one inserted, deleted or replaced letter apart, once, in some order."""
    keys = _keys(words)
    # a window of counts, and then the join, by one exchange
    sizes = keys.selectExpr("*", "count(1) over (partition by key) AS size")
    # the two sides share their exchange: the flags are looked at above the window
    a, b = sizes.filter(~F.col("longer")).alias("a"), sizes.alias("b")
    once = F.col("b.longer") | (F.col("a.word") < F.col("b.word"))
    met = a.filter(F.col("size") <= split).join(b.filter(F.col("size") <= split), (F.col("a.key") == F.col("b.key")) & once)
    # in this order: distances of long words cost the square of their length.  Spots are compared here, as a second
    # key of the join would have the rows that the window has already dealt out dealt out anew
    verified = F.when(~once | (F.col("a.spot") != F.col("b.spot")) | (_first_spot(F.length("a.word")) != F.col("a.spot")), False).otherwise(F.levenshtein("a.word", "b.word", 1) == 1)
    pair = [F.col("a.word"), F.col("a.n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")]
    common = met.filter(verified).select(*pair)
    crowded = sizes.filter(F.col("size") > split)
    # the words of a crowded bucket: equal lengths meet without the replaced letter, others in the shorter word
    word = F.col("word")
    left = F.when(F.col("longer"), _without_one(word, False)).otherwise(F.array_append(_without_one(word, True), F.xxhash64(F.lit(0), word)))
    parts = crowded.select("word", "n", "mask", "longer", "spot", F.explode(F.array_distinct(left)).alias("part"), "key")
    parts = parts.select("*", F.xxhash64("key", "part").alias("meet"))
    a, b = parts.filter(~F.col("longer")).alias("a"), parts.alias("b")
    met = a.join(b, (F.col("a.meet") == F.col("b.meet")) & once)
    # a letter of a run of equal ones may be left out at several places
    return common.unionByName(met.filter(verified).select(*pair).distinct())


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of each word with a form; paths double from round to round."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = up.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return up


def group_variants(words: DataFrame, ratio: int = RATIO, split: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the distinct words (word, n).

    ``form`` is the near word of largest n, the smallest one on ties, if that n is at least ``ratio`` times the word's;
    ``root`` is where forms lead to.  Counts grow by the ratio along forms, so their paths are short and have no rings.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants")
    words = sparkutil.table(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, split)
    ways = F.inline(F.array(*[F.struct(*[F.col(c).alias(a) for a, c in zip(("word", "n", "near", "near_n"), cols, strict=True)]) for cols in (("word", "n", "near", "near_n"), ("near", "near_n", "word", "n"))]))
    rows = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(pairs.select(ways))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near"))))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = out.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out = sparkutil.table(out, "spelling-forms")
    forms = out.filter(F.col("form").isNotNull())
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most / least, ratio) + 1e-9) if most else 0
    out = out.join(_roots(forms, steps), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def lossy_words(docs: DataFrame, modulus: int = 31, least: int = MIN_LENGTH) -> DataFrame:
    """The words of the contract: of runs whose hash with the document's id the modulus divides, a letter is lost."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    run = runs(docs, least).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return run.select(F.when(F.col("h") % modulus == 0, lost).otherwise(F.col("run")).alias("word"))


def variants_of_documents(docs: DataFrame) -> DataFrame:
    """The rows of the query: variants among the lossy words of ``docs``."""
    return group_variants(count_words(lossy_words(docs)))


#: The same rows by another way: words are near if leaving out one letter makes them equal.  crc32 is spelled out.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]{7,}')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run
), coded AS (
  SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM counted
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || code[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(length(code) // 2)]),
    lambda c, b: xor(c // 256, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, crc_table
), lossy AS (
  SELECT times, CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM lossy WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), shorter AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter AS a JOIN shorter AS b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter AS a JOIN words AS b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter AS a JOIN words AS b ON a.part = b.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND place = 1
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, walk.root, formed.n, CAST(formed.n_near AS BIGINT) AS n_near, formed.form_n
FROM formed JOIN walk ON walk.word = formed.word JOIN formed AS last ON last.word = walk.root AND last.form IS NULL
"""
