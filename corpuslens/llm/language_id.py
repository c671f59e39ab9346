"""Language identification: nearest of several clustered TF-IDF centroids per language, by cosine.

A text becomes a unit vector of square-root counts of hashed character 1- to 3-grams (lower-cased, everything but
letters folded to one blank), times inverse document frequencies of the learning sample.  Each language has a few
centroids from spherical k-means, without those that gather mislabelled rows; the nearest centroid's language wins, and a text whose cosine is under
``REJECT`` is marked as rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text that has no feature in common
with any centroid gets the most frequent learned language with score 0; repeated rows get equal results; very long texts are worked on whole, in stretches that bound memory; an empty
table gives an empty result; rows of one id and text count once in learning; without learned languages everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil
from corpuslens.llm import textkernel as tk

DIMS = 2048
WIDTH = DIMS + 256
#: Bounds of the learning sample: rows of one language, and of all together; but each language gets a row at least.
PER_LANGUAGE, SAMPLE_ROWS = 1000, 6000
CENTROIDS, ROUNDS = 4, 12
HELD_MODULUS, HELD = 4, 2
#: A text whose best cosine is under this is marked as rejected.
REJECT = 0.3

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[128:] = np.arange(128, 256)
_LATIN = np.zeros(256, bool)
_LATIN[0x41:0x5B] = _LATIN[0x61:0x7B] = True


def vectors(s: tk.Slice) -> np.ndarray:
    """Square-root counts of each row, rows by WIDTH."""
    folded = _FOLD[tk.lower_latin(s.buf)]
    chars = tk.chars(s, folded)
    out = np.zeros(s.rows * WIDTH)
    for k, salt in ((1, 0), (2, 0), (3, 0x51)):
        for value, off in tk.stretches(*chars, k):
            row = np.repeat(np.arange(s.rows), np.diff(off))
            blank = value == 0x20
            if k == 1:
                keep = ~blank
                at, bucket = row[keep], DIMS + np.where(value < 128, value, 128 + (value * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.int64)[keep]
            else:
                gram, place = tk.char_grams(value, off, k)
                keep = ~(blank[place] & blank[place + 1])
                at, bucket = row[place[keep]], ((gram + np.uint32(salt)) * np.uint32(0xC2B2AE35) >> np.uint32(21)).astype(np.int64)[keep]
            out += np.bincount(at * WIDTH + bucket, minlength=s.rows * WIDTH)
    return np.sqrt(out.reshape(s.rows, WIDTH)).astype(np.float32)


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None
    owner: np.ndarray | None = None

    def predict(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        cos = _unit(vectors(s) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1)
        return np.where(score > 0, self.owner[best], 0), score.astype(np.float64)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spread seeds; empty clusters are dropped."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == i].sum(0) for i in range(len(c)) if (own == i).any()]))
    return c


def _own(x: np.ndarray, label: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which centroids stay: those of wrongly labelled rows, to which rows of other languages are nearest, don't.

    Languages weigh alike, however many rows they have, and each keeps its best centroid.
    """
    near = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)])
    weight = 1 / np.bincount(label)[label]
    mine = label == owner[near]
    share = np.bincount(near, weight * mine, len(owner)) / np.maximum(np.bincount(near, weight, len(owner)), 1e-12)
    best = [np.flatnonzero(owner == i)[share[owner == i].argmax()] for i in np.unique(owner)]
    kept = share > 0.5
    kept[best] = True
    return kept


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from a bounded sample of the rows that have a language and aren't held out."""
    sparkutil.batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (sparkutil.id_crc() % HELD_MODULUS != HELD))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return LanguageModel()
    share = max(1, min(per_language, rows // len(counts)))
    # the hash keeps a few more than are wanted, of which exactly "share" are taken
    part = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.2 * share + 100) / r["count"])) for r in counts], "lang string, part double")
    place = sparkutil.unit_hash("doc_id", "text", salt="lang")
    sample = known.join(F.broadcast(part), "lang").withColumn("_place", place).filter(F.col("_place") < F.col("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))
    sample = sample.dropDuplicates(["lang", "_place"]).withColumn("_nth", nth).filter(F.col("_nth") <= share).select("text", "lang")

    @tk.tidy
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column("text")):
                x = vectors(s)
                at = np.flatnonzero(x)
                ptr = np.searchsorted(at, np.arange(s.rows + 1) * WIDTH).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(v)) for v in ((at % WIDTH).astype(np.int32), x.ravel()[at])]
                yield pa.RecordBatch.from_arrays([*lists, batch.column("lang").slice(s.row0, s.rows)], ["idx", "val", "lang"])

    got = sample.mapInArrow(rows_of, "idx array<int>, val array<float>, lang string").toArrow()
    if not got.num_rows:
        return LanguageModel()
    lang = np.array(got.column("lang").to_pylist(), object)
    lists, vals = (pa.concat_arrays(got.column(c).chunks) for c in ("idx", "val"))
    x = np.zeros((len(lang), WIDTH), np.float32)
    x[np.repeat(np.arange(len(lang)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()] = vals.values.to_numpy()
    idf = (np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 0.1).astype(np.float32)
    x = _unit(x * idf)
    at: dict[str, list[int]] = {}
    for i, name in enumerate(lang):
        at.setdefault(name, []).append(i)
    languages = [r["lang"] for r in counts if r["lang"] in at]
    found = [_cluster(x[at[name]], CENTROIDS) for name in languages]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
    centroids = np.concatenate(found)
    label = np.zeros(len(x), np.int64)
    for i, name in enumerate(languages):
        label[at[name]] = i
    kept = _own(x, label, centroids, owner)
    return LanguageModel(languages, idf, centroids[kept], owner[kept])


def predict_column(model: LanguageModel, text="text"):
    """Struct column: lang_pred, score, rejected."""

    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*model.languages, "und"], object)
        for texts in batches:
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for s in tk.slices(texts) if model.languages else ():
                b, c = model.predict(s)
                letters = tk.count_in_rows(s, _LATIN[s.buf]) > 0
                for i in np.flatnonzero(~letters):  # no ASCII letter: look at each character
                    letters[i] = any(map(str.isalpha, s.buf[s.off[i] : s.off[i + 1]].tobytes().decode()))
                at = slice(s.row0, s.row0 + s.rows)
                best[at], score[at] = np.where(letters, b, len(names) - 1), np.where(letters, c, 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(score < REJECT)], ["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean").asNondeterministic()(F.col(text))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row."""
    out = docs.select("doc_id", predict_column(fit(docs, per_language, rows)).alias("_p"))
    return out.select("doc_id", (sparkutil.id_crc() % HELD_MODULUS == HELD).alias("held_out"), "_p.*")
