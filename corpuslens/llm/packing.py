"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Texts become token ids plus an end mark; only documents longer than a sequence are cut.  The histogram of piece
lengths (as many rows as a sequence has tokens) is planned on the driver: patterns of two to four lengths that fill
a sequence are enumerated, their repeat counts are fitted by non-negative least squares and rounded down, and what
remains is packed by best fit, longest first.  The plan maps the n-th piece of a length to a sequence and a place;
pieces are numbered within their length by their place in their task plus the counts of the tasks before it, so a
length that a third of all pieces share is never gathered.

Defined cases: a null or empty text is one piece that holds the end mark alone; a null doc_id is kept as null;
repeated rows are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil
from corpuslens.llm import textkernel as tk

LENGTH = 2048
END_ID = 0
#: Most patterns that are fitted, and entries of a worker's token cache.
PATTERNS, CACHE = 24_000, 350_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer has to give the same ids for whether it sees the text or its chunks.
PROBE = "The QUICK brown-fox's, 12,5 x. \u0130stanbul \u00c9T\u00c9, e\u0301. a\tb\r\nc  d \u65e5\u672c\u3002 \u0395\u03a3\u039f\u03a3 \u00bd!? snake_case  End"


def _stays(c: str) -> bool:
    """Whether a character is a letter that lower-casing and normal forms leave one letter: a capital I with a dot isn't."""
    return c.isalpha() and (c.isascii() or c < "\u02b0") and c != "\u0130"


class ChunkTokenizer:
    """Ids of whole texts, with a cache for the chunks between blanks.

    Exact for lower-casing tokenizers that drop white space and never join pieces across it; others are refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kind, self._code = (np.uint16, "H") if self._tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        self._cache: dict[str, bytes] = {}
        # the characters that byte-level tokenizers write bytes as
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self._byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        if self.ids([PROBE])[0].tolist() != self._tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path}: this tokenizer's ids of a text are not those of its parts between blanks")

    def _encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of chunks; a lower-case run of Latin letters is one pre-token and goes straight to the model."""
        tokenize, table, code = self._tokenizer.model.tokenize, self._byte_chars, self._code
        mixed = []
        for c in chunks:
            if c.isalpha() and c == c.lower() and (c.isascii() or max(c) < "\u02b0"):
                name = c if c.isascii() else "".join(map(table.__getitem__, c.encode()))
                yield c, array(code, [t.id for t in tokenize(name)]).tobytes()
            else:
                mixed.append(c)
        for c, e in zip(mixed, self._tokenizer.encode_batch_fast(mixed, add_special_tokens=False), strict=True):
            yield c, array(code, e.ids).tobytes()

    @staticmethod
    def _chunks(text: str) -> list[str]:
        # lower case now, so that more chunks are equal; not where it depends on neighbours or makes a special token
        if "<|" not in text and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def forget(self) -> None:
        self._cache.clear()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; chunks that aren't cached are encoded in one call."""
        chunks = [self._chunks(t) for t in texts]
        every = set().union(*chunks)
        if len(self._cache) > CACHE:
            self._cache.clear()
        new = every.difference(self._cache)
        cache = self._cache
        # a letter that stays one letter and a mark after it are never one pre-token: such a chunk is the ids of both
        ended = [c for c in new if len(c) > 1 and c[-1] in ",." and _stays(c[-2]) and "<|" not in c]
        new.difference_update(ended)
        new.update(c for c in (*",.", *(c[:-1] for c in ended)) if c not in cache)
        new = list(new)
        cache.update(self._encode(new))
        for c in ended:
            cache[c] = cache[c[:-1]] + cache[c[-1]]
        new += ended
        out = [np.frombuffer(b"".join(map(cache.__getitem__, c)), self._kind) for c in chunks]
        for c in new:
            if len(c) > 64:  # rare and large
                del cache[c]
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, which may run many tasks; each of them forgets its chunks."""
    return ChunkTokenizer(path)


def _portions(texts: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    """Texts of a batch in lists of about ``most`` characters."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its number among the pieces of its length in its task (``part``, ``nth``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = _tokenizer(tokenizer), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        try:
            for batch in batches:
                own, piece, size, crc, nth, all_ids = [], [], [], [], [], []
                for i, ids in enumerate(chain.from_iterable(map(tok.ids, _portions(batch.column("text"))))):
                    ids = np.append(ids, ids.dtype.type(END_ID)).astype("<u4")
                    for p in range(-(-len(ids) // length)):
                        cut = ids[p * length : (p + 1) * length]
                        own.append(i)
                        piece.append(p)
                        size.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        nth.append(seen[len(cut)])
                        seen[len(cut)] += 1
                        if with_ids:
                            all_ids.append(cut.astype(np.int32))
                cols = [
                    batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * length), pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(own), part, np.int32)), pa.array(nth, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            tok.forget()

    sparkutil.batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def enumerate_patterns(have: np.ndarray, length: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that occur and fill a sequence exactly, evenly thinned to ``most``."""
    there = np.flatnonzero(have)
    there = there[(there > 0) & (there < length)]
    ok = np.zeros(length + 1, bool)
    ok[there] = True
    out = [(int(a), int(length - a)) for a in there if 2 * a <= length and ok[length - a]]
    for size, share in ((3, 0.6), (4, 0.3)):
        a = there[there <= length // size]
        if not len(a):
            continue
        b = there
        if size == 3:
            x, y = np.meshgrid(a, b, indexing="ij")
            rest = length - x - y
            good = (x <= y) & (y <= rest)
            found = np.stack([x[good], y[good], rest[good]], 1)
        else:
            a, b = a[:: max(1, len(a) // 48)], b[:: max(1, len(b) // 48)]
            x, y, z = np.meshgrid(a, b, b, indexing="ij")
            rest = length - x - y - z
            good = (x <= y) & (y <= z) & (z <= rest)
            found = np.stack([x[good], y[good], z[good], rest[good]], 1)
        found = found[ok[found[:, -1]]]
        step = max(1, int(np.ceil(len(found) / (most * share))))
        out += [tuple(map(int, p)) for p in found[::step]]
    return out


def fit_counts(patterns: list[tuple[int, ...]], have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - have||, by accelerated projected gradient steps."""
    row = np.concatenate([np.array(p) for p in patterns])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    # the largest eigenvalue of A'A is at most its largest row sum
    use = np.bincount(row, minlength=len(have))
    bound = np.bincount(col, use[row], len(patterns)).max()
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        gap = np.bincount(row, y[col], len(have)) - have
        new = np.maximum(y - np.bincount(col, gap[row], len(patterns)) / bound, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """Runs: pieces ``rank`` to ``rank + n`` of a length go to sequences ``seq``, ``seq + 1``, ... at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length * (1 << 40) + self.rank
        at = np.searchsorted(key, length * (1 << 40) + rank, "right") - 1
        return self.seq[at] + rank - self.rank[at], self.offset[at]


def make_plan(have: np.ndarray, length: int = LENGTH) -> Plan:
    """Pack ``have[l]`` pieces of each length l into few sequences of ``length`` tokens."""
    have = have.astype(np.int64)
    left, used, seq = have.copy(), np.zeros(length + 1, np.int64), 0
    runs: list[tuple[int, int, int, int]] = []

    def put(size: int, n: int, first: int, offset: int) -> None:
        runs.append((size, int(used[size]), first, offset))
        used[size] += n
        left[size] -= n

    if left[length]:
        n = int(left[length])
        put(length, n, seq, 0)
        seq += n
    patterns = enumerate_patterns(left, length)
    if patterns:
        x = np.floor(fit_counts(patterns, left.astype(float)) + 1e-6).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if x[j] <= 0:
                break
            need = np.bincount(patterns[j], minlength=length + 1)
            sizes = np.flatnonzero(need)
            n = int(min(x[j], (left[sizes] // need[sizes]).min()))
            if n <= 0:
                continue
            offset = 0
            for size in patterns[j]:
                put(size, n, seq, offset)
                offset += size
            seq += n
    # best fit of the rest: open sequences by the room they have, as ranges (first, n)
    room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    rooms = np.zeros(length + 1, bool)
    for size in range(length, 0, -1):
        while left[size]:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                each = length // size
                n = max(1, int(left[size]) // each)
                k = min(each, int(left[size]))
                for i in range(k):
                    put(size, n, seq, i * size)
                room[length - k * size].append((seq, n))
                rooms[length - k * size] = True
                seq += n
                continue
            r = size + int(fits[0])
            first, n = room[r].pop()
            k = min(n, int(left[size]))
            put(size, k, first, length - r)
            if k < n:
                room[r].append((first + k, n - k))
            rooms[r] = bool(room[r])
            room[r - size].append((first, k))
            rooms[r - size] = True
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4)
    return Plan(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], seq)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece (and its ids, if asked for)."""
    rows = sparkutil.table(pieces(docs, tokenizer or default_tokenizer(), length, with_ids), "pieces")
    counts = sparkutil.table(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    have = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        have[r["length"]] = r["n"]
    plan = make_plan(have, length)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = sparkutil.small(base, counts.count())

    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, rank in batches:
            s, o = plan.place(size.to_numpy(), rank.to_numpy())
            yield pa.StructArray.from_arrays([pa.array(s), pa.array(o)], ["sequence_id", "offset"])

    at = F.arrow_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("base") + F.col("nth"))
    out = rows.join(base, ["length", "part"]).withColumn("_at", at)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", *["ids"] * with_ids)
