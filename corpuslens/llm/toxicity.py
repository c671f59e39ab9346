"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are densities of learned lexicons (words, and beginnings of words, that labelled
toxic texts use far more often than others), nearness of second-person words to lexicon hits, capitals,
punctuation and obfuscation rates.  Lexicons of the training rows are cross-fitted: a row's features come from a
lexicon learned without its fold.

Defined cases: a null or empty text has all-zero features and gets the score of such a text; repeated rows get
equal scores; very long texts are worked on whole, in stretches that bound memory; an empty table gives an empty result; labels other than 0 and 1 aren't used, nor more than one row of an
id; without labels of both classes every score is 0 (or 1 if all
labels are 1); other columns are kept by :func:`filter_toxic` and ignored by :func:`score_toxicity`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import models, sparkutil
from corpuslens.llm import textkernel as tk

#: Bound on the labelled rows of each class that the model is fitted on.
PER_CLASS = 2500
HELD_MODULUS, HELD = 5, 0
THRESHOLD = 0.5
FOLDS = 5
#: Least log-odds and documents of a lexicon entry; bytes of a beginning of a word; words that count as near.
MIN_LOG_ODDS, MIN_DOCS, PREFIX_BYTES, NEAR = 2.5, 3, 5, 5

# fixed values: second-person words of English, French, German and Spanish
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti usted ustedes vosotros tuyo"
_SECOND = np.sort(np.array([tk.hash_text(w) for w in SECOND_PERSON.split()], np.uint64))

_LEET = np.arange(256, dtype=np.uint8)
for _from, _to in zip(b"013457@", b"oieasta", strict=True):
    _LEET[_from] = _to
_ALPHA_SEP = tk.ALNUM_SEP.copy()
_ALPHA_SEP[0x30:0x3A] = True
_UPPER, _LETTER, _PUNCT, _DIGIT, _OBF = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[128:] = True
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = True
_DIGIT[0x30:0x3A] = True
_OBF[list(b"*@$!013457")] = True

FEATURES = [
    "word_density", "word_hits", "prefix_density", "prefix_hits", "log_odds_density", "log_odds_max", "distinct_hits",
    "second_density", "second_near", "upper_share", "caps_words", "exclaim_density", "question_density", "punct_density",
    "digit_share", "obfuscated_words", "obfuscated_hits", "stretched", "log_words",
]


@dataclass
class Lexicon:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prefixes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _tokens(s: tk.Slice):
    low = tk.lower_latin(s.buf)
    start, end, row = tk.find_words(s, tk.ALNUM_SEP)
    words = tk.hash_spans(low, start, end)
    long = end - start > PREFIX_BYTES
    heads = tk.hash_spans(low, start[long], start[long] + PREFIX_BYTES)
    return low, start, end, row, words, heads, row[long]


def _inside_rows(s: tk.Slice, flags: np.ndarray, *steps: int) -> np.ndarray:
    """``flags`` without the places so many bytes after (or before) a row's beginning: their neighbours are in other rows."""
    for step in steps:
        at = s.off[1:-1] + step
        flags[at[(at >= 0) & (at < len(flags))]] = False
    return flags


def dense_features(s: tk.Slice, lex: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text of the slice; large arrays are dropped as soon as they are used."""
    n = s.rows
    low, start, end, row, words, heads, head_row = _tokens(s)
    n_words = np.bincount(row, minlength=n)
    count = np.maximum(n_words, 1)
    size = np.maximum(np.diff(s.off), 1)
    head_hits = np.bincount(head_row[tk.in_sorted(heads, lex.prefixes) >= 0], minlength=n)
    del heads, head_row
    upper = _UPPER[s.buf]
    letters, capitals = tk.count_in_rows(s, _LETTER[s.buf]), tk.count_in_rows(s, upper)
    cum = tk.running(upper)
    caps = np.bincount(row[(cum[end] - cum[start] == end - start) & (end - start > 1)], minlength=n)
    del upper, cum, start, end
    at = tk.in_sorted(words, lex.words)
    second = tk.in_sorted(words, _SECOND) >= 0
    del words
    hit = at >= 0
    hit_row, hit_at = row[hit], at[hit]
    hits = np.bincount(hit_row, minlength=n)
    odds = lex.odds[hit_at]
    odds_max = np.zeros(n)
    np.maximum.at(odds_max, hit_row, odds)
    distinct = np.unique(hit_row * (len(lex.words) + 1) + hit_at) // (len(lex.words) + 1)
    place, h = np.flatnonzero(second), np.flatnonzero(hit)
    n_second = np.bincount(row[second], minlength=n)
    del at, hit, second
    near = np.zeros(n)
    if len(place) and len(h):
        i = np.searchsorted(place, h)
        close = np.zeros(len(h), bool)
        for j in (i - 1, i):
            ok = (j >= 0) & (j < len(place))
            p = place[np.clip(j, 0, len(place) - 1)]
            close |= ok & (np.abs(p - h) <= NEAR) & (row[p] == row[h])
        near = np.bincount(row[h[close]], minlength=n)
    del row
    inner = np.zeros(len(s.buf), bool)
    stretched = np.zeros(len(s.buf), bool)
    if len(s.buf) > 2:
        inner[1:-1] = _OBF[s.buf[1:-1]] & _LETTER[s.buf[:-2]] & _LETTER[s.buf[2:]]
        stretched[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[low[2:]]
    inner, stretched = tk.count_in_rows(s, _inside_rows(s, inner, -1, 0)), tk.count_in_rows(s, _inside_rows(s, stretched, 0, 1))
    plain = _LEET[low]
    changed = tk.running(plain != low)
    a, b, r = tk.find_words(tk.Slice(0, plain, s.off), _ALPHA_SEP)
    leet = changed[b] > changed[a]
    del changed
    a, b, r = a[leet], b[leet], r[leet]
    masked = tk.in_sorted(tk.hash_spans(plain, a, b), lex.words) >= 0 if len(a) else np.zeros(0, bool)
    out = [
        100 * hits / count, np.log1p(hits), 100 * head_hits / count, np.log1p(head_hits), np.bincount(hit_row, odds, minlength=n) / count * 10, odds_max,
        np.log1p(np.bincount(distinct, minlength=n)), n_second / count, near / np.maximum(hits, 1),
        capitals / np.maximum(letters, 1), caps / count, tk.count_in_rows(s, s.buf == 0x21) / count,
        tk.count_in_rows(s, s.buf == 0x3F) / count, tk.count_in_rows(s, _PUNCT[s.buf]) / size, tk.count_in_rows(s, _DIGIT[s.buf]) / size,
        inner / count, np.log1p(np.bincount(r[masked], minlength=n)), stretched / size, np.log1p(n_words),
    ]
    return np.stack(out, 1).astype(np.float64)


@tk.tidy
def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in tk.slices(batch.column("text")):
            _, _, _, row, words, heads, head_row = _tokens(s)
            cols = []
            for own, values in ((row, words), (head_row, heads)):
                order = np.lexsort((values, own))
                own, values = own[order], values[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
                ptr = np.searchsorted(own[new], np.arange(s.rows + 1)).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ptr), pa.array(values[new].view(np.int64))))
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c).slice(s.row0, s.rows) for c in ("label", "fold"))], ["words", "heads", "label", "fold"])


def _log_odds(values, toxic, n_toxic, n_clean):
    """Entries that mark toxic documents, and their log-odds; values come once for each document."""
    entry, inverse = np.unique(values, return_inverse=True)
    t = np.bincount(inverse, toxic, minlength=len(entry))
    c = np.bincount(inverse, ~toxic, minlength=len(entry))
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    ok = (t >= MIN_DOCS) & (odds >= MIN_LOG_ODDS)
    return entry[ok], odds[ok]


def _lexicon(words, word_doc, heads, head_doc, y, take) -> Lexicon:
    n_toxic, n_clean = int((y[take] == 1).sum()), int((y[take] == 0).sum())
    keep_w, keep_h = take[word_doc], take[head_doc]
    w, odds = _log_odds(words[keep_w], y[word_doc[keep_w]] == 1, n_toxic, n_clean)
    h, _ = _log_odds(heads[keep_h], y[head_doc[keep_h]] == 1, n_toxic, n_clean)
    return Lexicon(w, odds, h)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    boosted: tuple | None
    curve: models.Isotonic

    def score(self, s: tk.Slice) -> np.ndarray:
        if self.boosted is None:
            return np.full(s.rows, self.curve.y[0])
        return np.clip(self.curve(models.boosted_score(self.boosted, dense_features(s, self.lexicon))), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class."""
    sparkutil.batches(docs.sparkSession)
    sample, weight = sparkutil.labelled_sample(docs, labels, "toxic", HELD_MODULUS, HELD, per_class)
    sample = sparkutil.table(sample.filter(F.col("text").isNotNull()).groupBy("text").agg(F.max("label").alias("label"), F.min("fold").alias("fold")), "toxic-sample")
    got = sample.mapInArrow(_vocabulary, "words array<long>, heads array<long>, label int, fold int").toArrow()
    y, fold = got.column("label").to_numpy(), got.column("fold").to_numpy()
    if len(y) < 4 or y.min() == y.max():
        return ToxicityModel(Lexicon(), None, models.Isotonic(np.zeros(1), np.full(1, float(len(y) and y.max()))))
    flat = []
    for name in ("words", "heads"):
        lists = pa.concat_arrays(got.column(name).chunks)
        flat += [lists.values.to_numpy().view(np.uint64), np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))]
    crossed = [_lexicon(*flat, y, fold != k) for k in range(FOLDS)]
    lexicon = _lexicon(*flat, y, np.ones(len(y), bool))

    @tk.tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for s in tk.slices(batch.column("text")):
                own = fold[s.row0 : s.row0 + s.rows]
                x = np.zeros((s.rows, len(FEATURES)))
                for k in np.unique(own):
                    x[own == k] = dense_features(s, crossed[k])[own == k]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows, *(batch.column(c).slice(s.row0, s.rows) for c in ("label", "fold"))], ["x", "label", "fold"])

    got = sample.mapInArrow(features, "x array<double>, label int, fold int").toArrow()
    x = pa.concat_arrays(got.column("x").chunks).flatten().to_numpy().reshape(-1, len(FEATURES))
    y, fold = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy()
    w = np.array([weight[int(v)] for v in y])
    both = lambda m: m.any() and y[m].min() != y[m].max()
    learn = fold != 0 if both(fold != 0) else np.ones(len(y), bool)
    boosted = models.fit_boosted(x[learn], y[learn], w[learn])
    held = ~learn if (~learn).sum() >= 20 and both(~learn) else np.ones(len(y), bool)
    return ToxicityModel(lexicon, boosted, models.fit_isotonic(models.boosted_score(boosted, x[held]), y[held], w[held]))


def score_column(model: ToxicityModel, text="text"):
    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(s) for s in tk.slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(run, "double").asNondeterministic()(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = docs.select("doc_id", score_column(fit(docs, labels, per_class)).alias("score"))
    return out.select("doc_id", (sparkutil.id_crc() % HELD_MODULUS == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    return docs.filter(score_column(fit(docs, labels, per_class)) < THRESHOLD)
