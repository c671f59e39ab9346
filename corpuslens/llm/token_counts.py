"""Token counts that follow edits: segment trees over pre-token blocks, re-encoding only what an edit touches.

A document's pre-tokens are grouped into leaves; a complete binary tree over the leaves keeps, for each subtree,
its characters, its pre-tokens and its tokens.  An edit finds its leaf by descending on characters, cuts the text
from that leaf on into pre-tokens again until a pre-token begins where an untouched leaf begins, re-encodes only
those, and updates the sums on the paths above.  Leaves are made half full, so most edits leave as many as there
were; where they don't, the smallest subtree with room is dealt out again, and the whole tree only when it is full.
A pre-token depends on its own characters and the two after it, so two characters of context before an edit and
meeting an old border after it make this exact.

Defined cases: a null text is an empty text; an edit's start and length are cut to the text's borders, a null start
or length counts as 0 and a null insertion as empty, and null or missing edits leave the text as it is; a null
doc_id is kept; repeated rows each get their result; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil
from corpuslens.llm import textkernel as tk

#: Pre-tokens of a leaf when it is made, and at most; entries of a worker's count cache.
LEAF, FULL, CACHE = 32, 64, 400_000
#: Characters after its end that a pre-token depends on.
CONTEXT = 2
TREE = "chars array<int>, pretokens array<int>, tokens array<int>"
EDITS = "array<struct<start: int, length: int, insertion: string>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PretokenCounter:
    """Pre-tokens of a byte-level BPE and their token counts; special strings count as ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._cache: dict[str, int] = {}
        self.encoded = 0

    def counts(self, pretokens: list[str]) -> list[int]:
        self.encoded += len(pretokens)
        new = set(pretokens).difference(self._cache)
        if new:
            if len(self._cache) + len(new) > CACHE:
                self._cache.clear()
                new = set(pretokens)
            new = list(new)
            for p, e in zip(new, self._tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self._cache[p] = len(e.ids)
        found = list(map(self._cache.__getitem__, pretokens))
        if len(self._cache) > CACHE:
            self._cache.clear()
        return found


@lru_cache(maxsize=2)
def _counter(path: str) -> PretokenCounter:
    """One for each worker process, which runs many tasks: what one of them counted the next ones know."""
    return PretokenCounter(path)


class SegmentTree:
    """Sums of (characters, pre-tokens, tokens) over a complete binary tree; leaves are in text order."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes  # (2 * slots, 3); node 1 is the root, leaves begin at `slots`
        self.slots = len(nodes) // 2
        self.written = 0  # nodes that edits have written

    @classmethod
    def of_leaves(cls, leaves: np.ndarray, least: int = 1) -> SegmentTree:
        slots = max(least, 1 << max(0, (len(leaves) - 1).bit_length()))
        nodes = np.zeros((2 * slots, 3), np.int32)
        nodes[slots + np.arange(len(leaves)) * slots // max(1, len(leaves))] = leaves
        at = slots
        while at > 1:
            nodes[at // 2 : at] = nodes[at : 2 * at : 2] + nodes[at + 1 : 2 * at : 2]
            at //= 2
        return cls(nodes)

    def total(self) -> np.ndarray:
        return self.nodes[1]

    def find(self, position: int) -> tuple[int, int]:
        """The last leaf that begins at or before a character position (and isn't empty, if it can), and its begin."""
        node, begin = 1, 0
        while node < self.slots:
            left = 2 * node
            if position - begin >= self.nodes[left, 0] and self.nodes[left + 1, 0] > 0:
                begin += int(self.nodes[left, 0])
                node = left + 1
            else:
                node = left
        return node - self.slots, begin

    def replace(self, first: int, end: int, leaves: np.ndarray) -> SegmentTree:
        """Put ``leaves`` in place of leaves ``first`` to ``end``; only what lies above changed leaves is summed again.

        Leaves that don't fit there are dealt out evenly over the smallest subtree around them that has room to spare;
        only a tree that is full as a whole is made anew, twice as large.
        """
        if len(leaves) > end - first:
            width = 1
            while True:
                width *= 2
                if width > self.slots:
                    grown = SegmentTree.of_leaves(self._with(0, self.slots, first, end, leaves), 2 * self.slots)
                    grown.written += self.written
                    return grown
                low = first // width * width
                if end <= low + width:
                    every = self._with(low, low + width, first, end, leaves)
                    if 4 * len(every) <= 3 * width:
                        break
            first, end, leaves = low, low + width, every
        block = np.zeros((end - first, 3), np.int32)
        block[np.arange(len(leaves)) * (end - first) // max(1, len(leaves))] = leaves
        self.nodes[self.slots + first : self.slots + end] = block
        self.written += end - first
        a, b = (self.slots + first) // 2, (self.slots + end - 1) // 2
        while a >= 1:
            self.nodes[a : b + 1] = self.nodes[2 * a : 2 * b + 2 : 2] + self.nodes[2 * a + 1 : 2 * b + 2 : 2]
            self.written += b + 1 - a
            a, b = a // 2, b // 2
        return self

    def _with(self, low: int, high: int, first: int, end: int, leaves: np.ndarray) -> np.ndarray:
        """The leaves of a subtree that aren't empty, with ``leaves`` in place of some."""
        own = self.nodes[self.slots :]
        every = np.concatenate([own[low:first], leaves, own[end:high]])
        return every[every[:, 0] > 0]


def _leaves(pretokens: list[str], counts: list[int], room: int = 0) -> np.ndarray:
    """Leaves of the pre-tokens: as many as there is ``room`` for, if that makes none too full, else of ``LEAF`` each."""
    n = len(pretokens)
    if not n:
        return np.zeros((0, 3), np.int32)
    at = np.arange(0, n, max(LEAF, -(-n // room) if 0 < n <= FULL * room else 0))
    chars = np.add.reduceat(np.fromiter(map(len, pretokens), np.int64, n), at)
    return np.stack([chars, np.diff(np.append(at, n)), np.add.reduceat(np.array(counts), at)], 1).astype(np.int32)


def build(text: str, counter: PretokenCounter) -> SegmentTree:
    pre = counter.pattern.findall(text)
    return SegmentTree.of_leaves(_leaves(pre, counter.counts(pre)))


def edit(text: str, tree: SegmentTree, start: int, length: int, insertion: str, counter: PretokenCounter) -> tuple[str, SegmentTree]:
    """The edited text and its tree."""
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    new = text[:start] + insertion + text[start + length :]
    shift = len(insertion) - length
    first, begin = tree.find(max(start - CONTEXT, 0))
    # borders of the leaves behind the edit, as they lie in the new text
    sizes = tree.nodes[tree.slots :, 0]
    last, border = first, begin
    while last < tree.slots and border < start + length:
        border += int(sizes[last])
        last += 1
    again: list[str] = []
    at = begin
    for m in counter.pattern.finditer(new, begin):
        while last < tree.slots and border + shift < at:
            border += int(sizes[last])
            last += 1
        if at == border + shift and at >= start + len(insertion) and last > first:
            break
        again.append(m.group())
        at = m.end()
    else:
        last = tree.slots
    return new, tree.replace(first, last, _leaves(again, counter.counts(again), last - first))


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text and the tree columns of each document: a table to keep beside the documents."""
    sparkutil.batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts in batches:
            parts = [build(t or "", counter).nodes for t in texts.to_pylist()]
            ptr = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.ascontiguousarray(flat[:, i]))) for i in range(3)], ["chars", "pretokens", "tokens"])

    return docs.select("doc_id", "text").withColumn("_t", F.arrow_udf(run, TREE)("text")).select("doc_id", "text", "_t.*")


def apply_edits(trees: DataFrame, tokenizer: str | None = None, keep_text: bool = True) -> DataFrame:
    """Apply the column ``edits`` (in order, each to the text the one before it left) to text and tree columns.

    Returns the rows with the new text (null without ``keep_text``) and tree, and ``reencoded``: the pre-tokens
    that were encoded again.
    """
    sparkutil.batches(trees.sparkSession)
    path = tokenizer or default_tokenizer()

    @tk.tidy
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts, chars, pretokens, tokens, edits in batches:
            out_text, out_tree, out_n = [], [], []
            flat = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in (chars, pretokens, tokens)], 1)
            end = np.cumsum([0, *pc.list_value_length(chars).to_numpy(zero_copy_only=False)])
            for i, (text, todo) in enumerate(zip(texts.to_pylist(), edits.to_pylist(), strict=True)):
                text = text or ""
                tree = SegmentTree(flat[end[i] : end[i + 1]].copy())
                before = counter.encoded
                for one in todo or ():
                    if one is not None:
                        text, tree = edit(text, tree, one["start"] or 0, one["length"] or 0, one["insertion"] or "", counter)
                out_text.append(text if keep_text else None)
                out_tree.append(tree.nodes)
                out_n.append(counter.encoded - before)
            ptr = np.concatenate([[0], np.cumsum([len(x) for x in out_tree])]).astype(np.int32)
            flat = np.concatenate(out_tree) if out_tree else np.zeros((0, 3), np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.ascontiguousarray(flat[:, i]))) for i in range(3)]
            yield pa.StructArray.from_arrays([pa.array(out_text, pa.string()), *lists, pa.array(out_n, pa.int64())], ["text", "chars", "pretokens", "tokens", "reencoded"])

    udf = F.arrow_udf(run, f"text string, {TREE}, reencoded long")
    out = trees.withColumn("_t", udf("text", "chars", "pretokens", "tokens", F.col("edits").cast(EDITS)))
    return out.select("doc_id", "_t.*")


def sample_edits(doc_id: str = "doc_id"):
    """Two edits of each document, fixed by its id: places all over the text, deletions of 0 to 30 characters."""
    insertions = F.array(*map(F.lit, ("", " and", "x", "'s 12", "\n\n", "  ", ", naïve ")))

    def one(salt: str):
        h = F.xxhash64(doc_id, F.lit(salt))
        return F.struct(
            F.pmod(h, F.length(F.coalesce("text", F.lit(""))) + 1).cast("int").alias("start"),
            F.pmod(F.shiftright(h, 17), F.lit(31)).cast("int").alias("length"),
            F.get(insertions, F.pmod(F.shiftright(h, 29), F.lit(7)).cast("int")).alias("insertion"),
        )

    return F.array(one("a"), one("b"))


def count_edited(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts of each document before and after :func:`sample_edits`, from its tree."""
    trees = build_trees(docs, tokenizer)
    root = lambda c: F.get(c, F.lit(1)).cast("long")
    before = trees.withColumns({"edits": sample_edits(), "_n": F.struct(F.col("doc_id").alias("id"), root("tokens").alias("n"), root("pretokens").alias("p"))})
    after = apply_edits(before.withColumn("doc_id", F.col("_n")), tokenizer, keep_text=False)
    return after.select(
        F.col("doc_id.id").alias("doc_id"), F.col("doc_id.n").alias("n_tokens"), F.col("doc_id.p").alias("n_pretokens"), root("chars").alias("n_chars_edited"),
        root("tokens").alias("n_tokens_edited"), root("pretokens").alias("n_pretokens_edited"), "reencoded",
    )
