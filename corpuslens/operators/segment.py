"""Words of Han text: a lexicon learned from the corpus, and the most likely way to cut a text into its words.

Candidates are runs of one to ``LONGEST`` Han characters.  A longer one is a word if it is frequent and its parts keep
together: wherever it is cut in two, it occurs far more often than its parts would meet by chance.  A text's words are
the best path over the lattice of all words in it, by the sum of the logarithms of their shares.

Tasks count and cut with numpy, many runs at a time: a step per character of the longest run, not of every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

LONGEST, MIN_COUNT, COHESION = 4, 5, 20.0
#: Words of a lexicon at most, the most frequent ones: it is sent to every task.
SIZE = 200_000
#: What Python gets of a text: its runs of Han characters.
RUNS = r"\p{IsHan}+"
#: Characters that are counted or cut at once, about; runs, from which on down they are cut one by one; entries of a direct table; words that a task counts before it hands them on.
CHARS, ONE_BY_ONE, TABLE, COUNTED = 1 << 19, 16, 1 << 22, 300_000
POINTS = 0x110000


def _han(x: Column) -> Column:
    """The Han runs of a text, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(RUNS), F.lit(0)), " ")


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``CHARS`` characters."""
    part, n = [], 0
    for x in texts:
        if part and n + len(x) > CHARS:
            yield part
            part, n = [], 0
        part.append(x)
        n += len(x)
    if part:
        yield part


def _points(texts: list[str], before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts of runs, with line ends between, after and so many before them; and which aren't of a run."""
    x = np.frombuffer(("\n" * before + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    return x, (x == 32) | (x == 10)


def _split(points: np.ndarray) -> list[str]:
    """Rows of code points as words."""
    text, k = points.astype("<u4").tobytes().decode("utf-32-le"), points.shape[1]
    return [text[i : i + k] for i in range(0, len(text), k)]


def _count(texts: list[str], longest: int) -> Iterator[tuple[list[str], list[int]]]:
    """Words of each length and how often they occur in runs."""
    x, gap = _points(texts)
    there = np.zeros(POINTS, bool)
    there[x] = True
    chars = np.flatnonzero(there)
    ids = np.zeros(POINTS, np.int64)
    ids[chars] = np.arange(len(chars))
    ids, d = ids[x], len(chars)
    # a word's number times the number of characters, plus the next character, names the word that is longer by one
    number, words, ok = np.zeros(len(x) + 1, np.int64), np.zeros((1, 0), np.int64), np.ones(len(x) + 1, bool)
    for k in range(1, longest + 1):
        number, ok = number[:-1] * d + ids[k - 1 :], ok[:-1] & ~gap[k - 1 :]
        if len(words) * d <= TABLE:
            n = np.bincount(number[ok], minlength=len(words) * d)
            named = np.flatnonzero(n)
            n, place = n[named], np.zeros(len(words) * d, np.int64)
            place[named] = np.arange(len(named))
            number = place[number]
        else:
            named, inverse, n = np.unique(number[ok], return_inverse=True, return_counts=True)
            number = np.zeros(len(number), np.int64)
            number[ok] = inverse
        if not len(named):
            return
        words = np.hstack([words[named // d], chars[named % d, None]])
        yield _split(words), n.tolist()


def grams(texts: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(word, n) of every run of up to ``longest`` Han characters, counted over all texts."""

    def rows(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for part in _parts([x for x in batch.column("runs").to_pylist() if x]):
                for words, n in _count(part, longest):
                    for w, m in zip(words, n, strict=True):
                        total[w] = total.get(w, 0) + m
                    if len(total) > COUNTED:
                        yield rows(total)
                        total = {}
        yield rows(total)

    found = texts.select(_han(F.col(text)).alias("runs")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, text: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT, cohesion: float = COHESION, size: int = SIZE) -> DataFrame:
    """(word, n, cost): the lexicon of a corpus; single characters are words, too."""
    from corpuslens.session import written_once

    counts = written_once(grams(texts, text, longest))
    total = counts.filter(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    long = counts.filter((F.length("word") > 1) & (F.col("n") >= min_count))
    cuts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring(F.col("word"), F.lit(1), i).alias("a"), F.substring(F.col("word"), i + 1, F.length("word")).alias("b")))
    parts = long.select("word", "n", F.explode(cuts).alias("c")).select("word", "n", "c.a", "c.b")
    for side in ("a", "b"):
        parts = parts.join(counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side)
    held = parts.join(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("held"))
    words = held.filter(F.col("held") >= cohesion).select("word", "n").unionByName(counts.filter(F.length("word") == 1))
    best = words.orderBy(F.desc("n"), F.length("word"), "word").limit(size)
    return best.join(F.broadcast(total)).select("word", "n", (-F.log(F.col("n") / F.col("total"))).alias("cost"))


def best_path(run: str, costs: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The cheapest way to cut a run into words; on ties the one whose last words are longest.  Unknown characters are words at a high cost."""
    best = [0.0] + [float("inf")] * len(run)
    back = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for begin in range(max(0, end - longest), end):
            cost = costs.get(run[begin:end], unknown if end - begin == 1 else None)
            if cost is not None and best[begin] + cost < best[end] - 1e-12:
                best[end], back[end] = best[begin] + cost, begin
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


class Cutter:
    """:func:`best_path` of all runs of many texts at once, by the same sums in the same order."""

    def __init__(self, costs: dict[str, float], unknown: float):
        self.longest, self.unknown = max(map(len, costs), default=1), unknown
        chars = sorted({c for w in costs for c in w})
        self.d = len(chars) + 1
        self.ids = np.zeros(POINTS, np.int64)  # 0: in no word
        self.ids[[ord(c) for c in chars]] = np.arange(1, self.d)
        number = {"": 1}  # of the beginnings of words; 0 is none
        keys = []
        for w in costs:
            for i in range(1, len(w) + 1):
                if w[:i] not in number:
                    number[w[:i]] = len(number) + 1
                    keys.append(number[w[: i - 1]] * self.d + int(self.ids[ord(w[i - 1])]))
        self.cost = np.full(len(number) + 1, np.inf)
        for w, c in costs.items():
            self.cost[number[w]] = c
        self.keys, self.next = np.array(keys, np.int64), np.arange(2, len(keys) + 2)
        self.table = None
        if (len(number) + 1) * self.d <= TABLE:
            self.table = np.zeros((len(number) + 1) * self.d, np.int32)
            self.table[self.keys] = self.next
        else:
            order = np.argsort(self.keys)
            self.keys, self.next = self.keys[order], self.next[order]

    def _longer(self, number: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The beginnings of words that are longer by the next character."""
        key = number * self.d + ids
        if self.table is not None:
            return self.table[key].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], 0)

    def __call__(self, texts: list[str]) -> list[str]:
        """The texts with a blank between any two words of a run."""
        most = self.longest
        x, gap = _points(texts, before=most)
        ids, number = self.ids[x], np.ones(len(x) + 1, np.int64)
        costs = []  # by length, of the word that begins at a place; a gap is in no word
        for k in range(1, most + 1):
            number = self._longer(number[:-1], ids[k - 1 :])
            cost = np.full(len(x), np.inf)
            cost[: len(number)] = self.cost[number]
            costs.append(cost)
        costs[0][np.isinf(costs[0]) & ~gap] = self.unknown

        first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        size = np.flatnonzero(gap & np.r_[False, ~gap[:-1]]) - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best, back, t = np.zeros(len(x)), np.zeros(len(x), np.int64), 0
        left = np.searchsorted(-size, -np.arange(1, size[0] + 1) if len(size) else [], side="right")  # runs that have a t-th character
        while t < len(left) and left[t] > ONE_BY_ONE:
            end = first[: left[t]] + t + 1
            least, length = np.full(len(end), np.inf), np.zeros(len(end), np.int64)
            for k in range(most, 0, -1):
                cost = best[end - k] + costs[k - 1][end - k]
                better = cost < least - 1e-12
                least, length = np.where(better, cost, least), np.where(better, k, length)
            best[end], back[end] = least, length
            t += 1
        for at, n in zip(first[: left[t] if t < len(left) else 0].tolist(), size.tolist(), strict=False):
            own = best[at - most : at + n + 1].tolist()
            price = [c[at - most : at + n].tolist() for c in costs]
            lengths = [(k, price[k - 1]) for k in range(most, 0, -1)]
            for end in range(most + t + 1, most + n + 1):
                least, length = np.inf, 0
                for k, by in lengths:
                    cost = own[end - k] + by[end - k]
                    if cost < least - 1e-12:
                        least, length = cost, k
                own[end] = least
                back[at - most + end] = length

        begins = np.zeros(len(x), bool)
        at, start = first + size, first
        while len(at) > ONE_BY_ONE:
            at = at - back[at]
            inside = at > start
            at, start = at[inside], start[inside]
            begins[at] = True
        for end, begin in zip(at.tolist(), start.tolist(), strict=True):
            lengths, i, found = back[begin : end + 1].tolist(), end - begin, []
            while i := i - lengths[i]:
                found.append(begin + i)
            begins[found] = True
        x, begins = x[most:-1], begins[most:-1]
        out = np.full(len(x) + int(begins.sum()), 32, np.uint32)
        out[np.arange(len(x)) + np.cumsum(begins)] = x
        return out.tobytes().decode("utf-32-le").split("\n")


def terms(lexicon: DataFrame, mode: str = "words"):
    """A column function: search terms of a text, Han runs cut into the lexicon's words (``words``) or into characters (``characters``)."""
    if mode == "characters":
        return T.terms
    rows = lexicon.limit(SIZE).collect()
    costs = {r["word"]: r["cost"] for r in rows}
    cutter = Cutter(costs, max(costs.values(), default=0.0) + 10.0)

    # words go back as one text with blanks between them: a batch of lists of short strings takes fifty times its text
    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for part in _parts(batch.fillna("").tolist()):  # smaller batches go back than come
                some = [x for x in part if x]
                words = iter(cutter(some) if some else [])
                yield pd.Series([next(words) if x else None for x in part], dtype=object)

    def of(x: str | Column) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        # Python sees the Han runs of a text only, all of them joined by blanks, and gives null for none
        other = T.terms(F.regexp_replace(F.coalesce(x, F.lit("")), RUNS, " "))
        return F.concat(F.coalesce(F.split(cut(_han(x)), " ", -1), F.array().cast("array<string>")), other)

    return of
