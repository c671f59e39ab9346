"""Quality rules: exact base counts, then a calibrated hashed n-gram logistic regression.

Words are ``[^\\x20\\x09-\\x0D]+``.  Features are hashed character 4-grams, words and word pairs (a word that repeats
the one before it is written as a back reference), each group as shares of its own total.  The weights are
learned from a bounded sample of labelled rows, calibrated on rows left out of the fit, and every text is scored
whole, in Arrow batches, against fixed thresholds.

Defined cases: a null or empty text has no words, so ``base_failed``; repeated rows give repeated results;
very long texts are worked on whole, in stretches that bound memory; an
empty table gives an empty result; labels other than 0 and 1 aren't used, nor more than one row of an id; without labels of both classes the verdict is that of the base rules alone;
columns of other names are kept by :func:`filter_quality` and ignored by :func:`score_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import models, sparkutil
from corpuslens.llm import textkernel as tk

DIMS = 1 << 17
#: Bound on the labelled rows of each class that the model is fitted on.
PER_CLASS = 1500
#: Rows whose crc32(doc_id) mod 5 is 0 are never learned from.
HELD_MODULUS, HELD = 5, 0
#: Base rules: fewest words, and the most percent of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A text is kept if its probability of good quality is at least this.
MIN_PROBABILITY = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GROUPS = 3
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double"


@dataclass
class QualityModel:
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, z):
        return models.sigmoid(self.slope * (z + self.bias) + self.offset)


def base_counts(s: tk.Slice):
    """The five base columns of each row, and its words: (counts, word hashes, word rows)."""
    start, end, row = tk.find_words(s, tk.SPACE_SEP)
    n_words = np.bincount(row, minlength=s.rows)
    inside = ~tk.SPACE_SEP[s.buf]
    word_chars = tk.count_in_rows(s, inside & ((s.buf & 0xC0) != 0x80))
    symbols = tk.count_in_rows(s, _SYMBOL[s.buf])
    words = tk.hash_spans(s.buf, start, end)
    # lines
    breaks = np.flatnonzero(s.buf == 0x0A)
    a = np.sort(np.concatenate([s.off[:-1], breaks + 1]), kind="stable")
    b = np.sort(np.concatenate([s.off[1:], breaks]), kind="stable")
    full = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[full], b[full]
    line_row = np.searchsorted(s.off, a, "right") - 1
    key = tk.mix(tk.hash_spans(s.buf, a, b) + line_row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(key, return_index=True)
    dup_lines = np.bincount(line_row, minlength=s.rows) - np.bincount(line_row[first], minlength=s.rows)
    # repeated 5-word windows
    gram, at = tk.word_grams(words, row, 5)
    key = tk.mix(gram + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[counts[inverse] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    repeat = np.bincount(row[cover.cumsum()[:-1] > 0], minlength=s.rows)
    return (n_words, word_chars, symbols, dup_lines, repeat), words, row


def hashed_features(s: tk.Slice, words, row) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The group, the row and the bucket of every occurrence, rows ascending; a group can come in several parts."""
    top = np.uint64(64 - 17)
    for value, off in tk.stretches(*tk.chars(s, s.buf), 4):
        gram, at = tk.char_grams(value, off, 4)
        yield 0, np.searchsorted(off, at, "right") - 1, (gram >> np.uint32(32 - 17)).astype(np.int64)
    yield 1, row, (tk.mix(words + np.uint64(11)) >> top).astype(np.int64)
    if len(words) < 2:
        return
    back = np.where(words[1:] == words[:-1], np.uint64(1), words[1:])
    same = np.flatnonzero(row[1:] == row[:-1])
    # the first word of a pair is left out where the pair is a repetition, so that every repetition looks alike
    left = np.where(back == 1, np.uint64(7), words[:-1])
    pair = tk.mix(left * np.uint64(0xD6E8FEB86659FD93) + back)
    yield 2, row[same], (pair[same] >> top).astype(np.int64)


def linear_score(s: tk.Slice, words, row, weights) -> np.ndarray:
    total, n = np.zeros((2, _GROUPS, s.rows))
    for group, at, bucket in hashed_features(s, words, row):
        n[group] += np.bincount(at, minlength=s.rows)
        total[group] += np.bincount(at, weights[bucket], minlength=s.rows)
    return (total / np.maximum(n, 1)).sum(0)


def _verdicts(model: QualityModel):
    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for s in tk.slices(texts):
                counts, words, row = base_counts(s)
                n_words, _, _, _, repeat = counts
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
                if model.weights is None:
                    p = np.ones(s.rows)
                else:
                    p = model.probability(linear_score(s, words, row, model.weights))
                parts.append([*counts, failed, ~failed & (p >= MIN_PROBABILITY), p])
            names = [f.split()[0] for f in VERDICT.split(", ")]
            kinds = [np.int64] * 5 + [bool, bool, np.float64]
            cols = [pa.array(np.concatenate([p[i] for p in parts]).astype(k) if parts else np.zeros(0, k)) for i, k in enumerate(kinds)]
            yield pa.StructArray.from_arrays(cols, names)

    return run


@tk.tidy
def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in tk.slices(batch.column("text")):
            _, words, row = base_counts(s)
            idx, val, own = [], [], []
            groups: list[list[tuple]] = [[] for _ in range(_GROUPS)]
            for group, at, bucket in hashed_features(s, words, row):
                groups[group].append((at, bucket))
            for parts in filter(None, groups):
                at, bucket = map(np.concatenate, zip(*parts, strict=True))
                key, count = np.unique(at * DIMS + bucket, return_counts=True)
                r = key // DIMS
                own.append(r)
                idx.append(key % DIMS)
                val.append(count / np.bincount(at, minlength=s.rows)[r])
            own, idx, val = map(np.concatenate, (own, idx, val))
            order = np.argsort(own, kind="stable")
            ptr = np.searchsorted(own[order], np.arange(s.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(ptr), pa.array(idx[order].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ptr), pa.array(val[order].astype(np.float32))),
                    batch.column("label").slice(s.row0, s.rows),
                    batch.column("fold").slice(s.row0, s.rows),
                ],
                ["idx", "val", "label", "fold"],
            )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class; four folds learn, one calibrates."""
    sparkutil.batches(docs.sparkSession)
    sample, weight = sparkutil.labelled_sample(docs, labels, "quality", HELD_MODULUS, HELD, per_class)
    got = sample.mapInArrow(_sample_rows, "idx array<int>, val array<float>, label int, fold int").toArrow()
    y = got.column("label").to_numpy().astype(float)
    if len(y) < 4 or y.min() == y.max():
        return QualityModel()
    fold = got.column("fold").to_numpy()
    w = np.array([weight[int(v)] for v in y])
    lists, vals = (pa.concat_arrays(got.column(c).chunks) for c in ("idx", "val"))
    ptr, idx, val = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(), vals.values.to_numpy()
    learn = fold != 0 if 0 < (y[fold != 0]).sum() < (fold != 0).sum() else np.ones(len(y), bool)
    take = np.repeat(learn, np.diff(ptr))
    ptr_l = np.concatenate([[0], np.diff(ptr)[learn].cumsum()])
    balance = np.where(y[learn] == 1, 1 / max(1, y[learn].sum()), 1 / max(1, (1 - y[learn]).sum()))
    wt, b = models.fit_sparse_logistic(ptr_l, idx[take], val[take], y[learn], balance, DIMS)
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    z = np.bincount(row, wt[idx] * val, minlength=len(y)) + b
    held = ~learn if (~learn).sum() >= 20 and 0 < y[~learn].sum() < (~learn).sum() else np.ones(len(y), bool)
    slope, offset = models.fit_platt(z[held], y[held], w[held])
    return QualityModel(wt.astype(np.float32), b, slope, offset)


def verdict_column(model: QualityModel, text="text"):
    """Struct column with the base counts, ``base_failed``, ``kept`` and the calibrated probability."""
    return F.arrow_udf(_verdicts(model), VERDICT).asNondeterministic()(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and the verdict of each row of ``docs``."""
    model = fit(docs, labels, per_class)
    return docs.select("doc_id", verdict_column(model).alias("_v")).select("doc_id", "_v.*")


def filter_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.filter(verdict_column(fit(docs, labels, per_class))["kept"])
