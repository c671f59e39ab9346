"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Boosted trees over text statistics give conjunctive rules (the paths to their nodes); a lasso logistic fit keeps
a few of them; what is kept becomes one Spark expression over the statistics of a text.

Defined cases: a null or empty text has all-zero statistics and gets the score of such a text; repeated rows get
equal scores; very long texts are worked on whole, in stretches that bound memory; an empty table gives an empty result; labels other than 0 and 1 aren't used, nor more than one row of an
id; without labels of both classes every score is that of the one
class (1 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import models, sparkutil
from corpuslens.llm import textkernel as tk
from corpuslens.llm.quality_rules import base_counts

#: Bound on the labelled rows of each class that the rules are learned from.
PER_CLASS = 3000
HELD_MODULUS, HELD = 5, 0
THRESHOLD = 0.3
TREES, DEPTH, L1 = 24, 3, 2e-3

STATISTICS = [
    "n_words", "mean_word", "longest_word", "symbol_share", "upper_share", "digit_share", "punct_share", "space_share",
    "dup_lines", "repeat_words", "distinct_words", "adjacent_same", "short_words", "words_per_line", "end_marks", "bars", "exclaims",
]
_UPPER, _DIGIT, _PUNCT, _END = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = True
_END[list(b".!?")] = True


def statistics(s: tk.Slice) -> np.ndarray:
    """One row of STATISTICS for each text of the slice."""
    n = s.rows
    (n_words, chars, symbols, dup_lines, repeat), words, row = base_counts(s)
    start, end, _ = tk.find_words(s, tk.SPACE_SEP)
    count, size = np.maximum(n_words, 1), np.maximum(np.diff(s.off), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, row, end - start)
    key = tk.mix(words + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(key, return_index=True)
    lines = tk.count_in_rows(s, s.buf == 0x0A) + 1
    same = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    upper = tk.count_in_rows(s, _UPPER[s.buf])
    last = s.buf[end - 1] if len(end) else np.zeros(0, np.uint8)
    out = [
        n_words, chars / count, longest, symbols / size, upper / size, tk.count_in_rows(s, _DIGIT[s.buf]) / size, tk.count_in_rows(s, _PUNCT[s.buf]) / size,
        tk.count_in_rows(s, tk.SPACE_SEP[s.buf]) / size, dup_lines / lines, repeat / count, np.bincount(row[first], minlength=n) / count,
        np.bincount(row[1:][same], minlength=n) / count, np.bincount(row[end - start <= 2], minlength=n) / count, n_words / lines,
        np.bincount(row[_END[last]], minlength=n) / count, tk.count_in_rows(s, s.buf == 0x7C) / count, tk.count_in_rows(s, s.buf == 0x21) / count,
    ]
    return np.stack(out, 1).astype(np.float64)


def statistics_column(text="text") -> Column:
    """Struct of the statistics of a whole text."""

    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [statistics(s) for s in tk.slices(texts)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATISTICS))], STATISTICS)

    return F.arrow_udf(run, ", ".join(f"{c} double" for c in STATISTICS)).asNondeterministic()(F.col(text))


#: A condition: (statistic, True for "above", cut).  A rule: its conditions, all of which must hold.
Condition = tuple[str, bool, float]


@dataclass
class RuleEnsemble:
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    bias: float = 40.0

    def column(self, stats: str) -> Column:
        """The probability of good quality as a Spark expression over the struct column ``stats``."""
        z = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in conditions:
                value = F.col(f"{stats}.{name}")
                holds = holds & (value > cut if above else value <= cut)
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _paths(trees) -> list[tuple[Condition, ...]]:
    found: dict[tuple[Condition, ...], None] = {}
    for t in trees:
        stack = [(0, ())]
        while stack:
            node, conditions = stack.pop()
            if conditions:
                found[tuple(sorted(set(conditions)))] = None
            f = t.feature[node]
            if f >= 0:
                for above in (False, True):
                    stack.append((2 * node + 1 + above, (*conditions, (STATISTICS[f], above, float(t.cut[node])))))
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleEnsemble:
    """Learn rules from at most ``per_class`` labelled rows of each class."""
    sparkutil.batches(docs.sparkSession)
    sample, weight = sparkutil.labelled_sample(docs, labels, "quality", HELD_MODULUS, HELD, per_class)
    got = sample.select(statistics_column().alias("s"), "label").select("s.*", "label").toArrow()
    y = got.column("label").to_numpy().astype(float)
    if len(y) < 4 or y.min() == y.max():
        return RuleEnsemble(bias=40.0 if not len(y) or y.max() else -40.0)
    x = np.stack([got.column(c).to_numpy() for c in STATISTICS], 1)
    w = np.array([weight[int(v)] for v in y])
    _, trees = models.fit_boosted(x, y, w, trees=TREES, depth=DEPTH)
    rules = _paths(trees)
    place = {c: i for i, c in enumerate(STATISTICS)}
    fires = np.ones((len(y), len(rules)))
    for j, conditions in enumerate(rules):
        for name, above, cut in conditions:
            v = x[:, place[name]]
            fires[:, j] *= v > cut if above else v <= cut
    spread = fires.std(0)
    use = spread > 0
    coef, bias = models.fit_lasso_logistic(fires[:, use] / spread[use], y, w, L1)
    coef = coef / spread[use]
    kept = [(r, float(c)) for r, c in zip([r for r, u in zip(rules, use, strict=True) if u], coef, strict=True) if abs(c) > 1e-6]
    return RuleEnsemble(kept, bias)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    rules = fit(docs, labels, per_class)
    out = docs.select("doc_id", statistics_column().alias("_s")).select("doc_id", rules.column("_s").alias("score"))
    return out.select("doc_id", (sparkutil.id_crc() % HELD_MODULUS == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
