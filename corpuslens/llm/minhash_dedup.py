"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (lower-cased words; a text of fewer words is one shingle), each
labelled with how often it occurred before, so that no two are equal.  A sketch takes the ``ELL`` shingles with
the smallest values of one hash function and keeps them in text order; documents with an equal sketch are
candidates.  Two candidates are linked if an alignment of their shingle sequences, within the band that the
threshold allows, keeps at least 0.8 of all their shingles: matched / (n1 + n2 - matched) >= 0.8.

Equal texts are folded into one representative before sketching meets, and classes are the connected components
of the links.  Inside a bucket, pairs are compared only while they aren't connected yet, most similar first, so no
link between different classes is lost and no bucket writes out all its pairs.  Buckets whose members are those of
an earlier one are dropped.  Buckets over a bound are dealt into blocks, and a pivot, the bucket's smallest member,
joins each block; that connects a group of near copies, however large, in work that grows with its size.  Only if
the members of such a bucket then lie in several components, those meet again where they share one of the rarest fifth
of their shingles, which texts of similarity 0.8 always do: no link between classes is lost, and texts that share
no more than what very many have, or of which a fifth is their component's own, aren't compared.

Defined cases: null texts are alone in their class; empty texts (and all texts without words) are alike only if
they are equal; a null doc_id takes part, and a class whose ids are all null has a null class id; repeated rows are
in one class; an empty table gives an empty result; other columns are ignored (:func:`keep_one` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil
from corpuslens.llm import textkernel as tk

WORDS, THRESHOLD = 5, 0.8
#: Sketches of a document, and shingles in a sketch: texts with similarity 0.8 meet in one of them but for 1 in 10^5.
SKETCHES, ELL = 16, 3
#: Members, and shingles of them all, that one block of a bucket holds on average.
BLOCK_ROWS, BLOCK_SHINGLES = 200, 1_000_000
#: Buckets over the bound in which a member meets a pivot; the others are looked at if that left them unconnected.
PIVOTS = 4

_SEEDS = tk.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SKETCH = "sketches array<long>, n int"


def shingles(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled 32-bit shingles of a slice in text order, and the offsets of each row's."""
    start, end, row = tk.find_words(s, tk.ALNUM_SEP)
    words = tk.hash_spans(tk.LOWER[s.buf], start, end)
    gram, at = tk.word_grams(words, row, WORDS)
    own = row[at]
    n_words = np.bincount(row, minlength=s.rows)
    few = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(few):  # texts of fewer words are one shingle
        first = np.searchsorted(row, few)
        whole = []
        for f, n in zip(first, n_words[few], strict=True):
            acc = np.full(1, n, np.uint64)
            for i in range(f, f + n):
                acc = tk.mix(acc + words[i : i + 1])
            whole.append(acc)
        gram, own = np.concatenate([gram, *whole]), np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        gram, own = gram[order], own[order]
    # occurrence labels: the rank among equal shingles of the row
    key = tk.mix(gram + own.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    i = np.arange(len(k))
    nth = np.zeros(len(k), np.uint64)
    nth[order] = (i - np.maximum.accumulate(np.where(new, i, 0))).astype(np.uint64)
    label = (tk.mix(gram + nth * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    return label, np.searchsorted(own, np.arange(s.rows + 1))


def _least(label: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    """Places of the ``ell`` shingles with the smallest values of each hash function."""
    if len(label) <= ell:
        return np.broadcast_to(np.arange(ell), (len(seeds), ell))
    v = label.astype(np.uint64)[None, :] * seeds[:, None]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    return np.argpartition(v, ell - 1, axis=1)[:, :ell]


def sketch(label: np.ndarray) -> np.ndarray:
    """Order MinHash of one document: SKETCHES values, each of ELL shingles in text order."""
    ell = min(ELL, len(label))
    each = max(1, (1 << 20) // max(1, len(label)))  # hash functions at once
    at = np.sort(np.concatenate([_least(label, _SEEDS[i : i + each], ell) for i in range(0, SKETCHES, each)]), axis=1)
    acc = np.full(SKETCHES, ell, np.uint64)
    for i in range(ell):
        acc = tk.mix(acc + label[at[:, i]].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return acc


def _sketch_column(text="text"):
    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, sizes = [], []
            for s in tk.slices(texts):
                label, off = shingles(s)
                for i in range(s.rows):
                    own = label[off[i] : off[i + 1]]
                    sizes.append(len(own))
                    if len(own):
                        keys.append(sketch(own))
            ptr = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) > 0)]).astype(np.int32) * SKETCHES
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ptr), pa.array(flat.view(np.int64))), pa.array(sizes, pa.int32())], ["sketches", "n"])

    return F.arrow_udf(run, _SKETCH)(F.col(text))


def _shingle_column(text="text"):
    @tk.tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, ptr = [], [np.zeros(1, np.int64)]
            for s in tk.slices(texts):
                label, off = shingles(s)
                parts.append(label)
                ptr.append(off[1:] + ptr[-1][-1])
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ptr).astype(np.int32)), pa.array(flat.view(np.int32)))

    return F.arrow_udf(run, "array<int>")(F.col(text))


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the banded alignment of two shingle sequences reaches the threshold.

    Shingles of one document differ from each other, so an alignment is a rising sequence of matches; its longest
    one inside the band is found by patience sorting.
    """
    need = int(np.ceil(threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b, a, sorter=order)
    at = order[np.minimum(at, len(b) - 1)]
    i = np.flatnonzero(b[at] == a)
    j = at[i]
    shift = j - i
    # more than this off the diagonal, too few shingles remain to reach the threshold
    band = (shift <= len(b) - need) & (-shift <= len(a) - need)
    j = j[band]
    if len(j) < need:
        return False
    if (np.diff(j) > 0).all():
        return True
    tails = np.empty(len(j), np.int64)
    size = 0
    for x in j:
        k = int(np.searchsorted(tails[:size], x))
        tails[k] = x
        size = max(size, k + 1)
    return size >= need


def link_block(sketches: np.ndarray, shingle: list[np.ndarray], number: int, group: np.ndarray, left: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect the members of one block (with ``left``: only pairs of ``left`` and not ``left``).

    Only pairs whose first common sketch is ``number`` are looked at, and only until they are connected; members of
    one ``group`` are from the start.  How many shingles a member shares with each of those before it is counted for
    all of them in one pass; pairs that share enough are aligned, those that share most first.
    """
    n = len(shingle)
    _, parent, known = np.unique(group, return_index=True, return_inverse=True)
    parent = parent[known].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(set(parent)) == 1:
        return
    sizes = np.array([len(x) for x in shingle])
    need = THRESHOLD / (1 + THRESHOLD)
    off = np.concatenate([[0], np.cumsum(sizes)])
    _, ids = np.unique(np.concatenate(shingle), return_inverse=True)
    mark = np.zeros(len(ids), np.int32)
    for i in range(1, n):
        own = ids[off[i] : off[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[: off[i]]], off[:i])
        mark[own] = 0
        ok = shared >= need * (sizes[:i] + sizes[i]) - 1e-9
        if number:
            ok &= ~(sketches[:i, :number] == sketches[i, :number]).any(1)
        ok &= known[:i] != known[i]
        if left is not None:
            ok &= left[:i] != left[i]
        found = np.flatnonzero(ok)
        for j in found[np.argsort(-shared[found], kind="stable")].tolist():
            a, b = root(i), root(j)
            if a != b and aligned(shingle[i], shingle[j]):
                parent[a] = b
                yield i, j


_UNIT = ["unit_hash", "number", "bucket", "first", "second"]


@tk.tidy
def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit (bucket and pair of blocks); rows of a unit come one after another."""
    held: list[pa.RecordBatch] = []
    names = _UNIT

    def work(rows: pa.Table) -> pa.RecordBatch:
        keys, number = rows.column("key").to_pylist(), int(rows.column("number")[0].as_py())
        sketches = pa.concat_arrays(rows.column("sketches").chunks).flatten().to_numpy().reshape(len(keys), SKETCHES)
        lists = pa.concat_arrays(rows.column("shingles").chunks)
        off = lists.offsets.to_numpy()
        base, flat = off[0], lists.flatten().to_numpy().view(np.uint32)
        shingle = [flat[off[i] - base : off[i + 1] - base] for i in range(len(keys))]
        first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
        left = None if first == second else rows.column("block").to_numpy() == first
        roots = rows.column("root")
        group = np.arange(len(keys)) if roots.null_count else np.array(roots.to_pylist(), object)
        pairs = list(link_block(sketches, shingle, number if rows.column("skip")[0].as_py() else 0, group, left))
        return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in pairs], pa.binary()), pa.array([keys[b] for _, b in pairs], pa.binary())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names):
            yield work(pa.Table.from_batches(held))
            held = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x:
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield work(pa.Table.from_batches(held))


def _key(text):
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def find_links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between the keys of different texts, enough of them to connect every class."""
    spark = docs.sparkSession
    sparkutil.batches(spark)
    texts = docs.filter(F.col("text").isNotNull()).select("text", _key(F.col("text")).alias("key"))
    sketched = texts.select("key", _sketch_column().alias("s")).select("key", "s.*").filter("n > 0")
    # copies of a text have the same sketches: one row for each text
    first = sketched.groupBy("key").agg(F.first("sketches").alias("sketches"), F.first("n").alias("n"))
    first = sparkutil.table(first, "sketches")
    members = first.select("key", "n", F.posexplode("sketches").alias("number", "bucket"))
    shared = members.groupBy("number", "bucket").agg(
        F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("total"), F.min("key").alias("pivot"),
        F.bit_xor(F.xxhash64("key")).alias("xor"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("xor2"),
    ).filter("rows > 1")
    # of buckets with the same members the first one
    same = F.struct("number", "bucket", "pivot", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    shared = shared.groupBy("rows", "xor", "xor2").agg(F.min(same).alias("s")).select("s.*")
    shared = sparkutil.small(sparkutil.table(shared, "shared-buckets"))
    # a bucket that holds a large share of all rows is a skewed key of this join, which AQE splits: its rows are slim
    met = sparkutil.table(members.join(shared, ["number", "bucket"]).select("key", "number", "bucket", "blocks", "pivot"), "buckets")
    needed = sparkutil.small(sparkutil.table(met.select("key").distinct(), "bucket-keys"))
    own = texts.join(needed, "key", "left_semi").select("key", _shingle_column().alias("shingles"))
    own = own.groupBy("key").agg(F.first("shingles").alias("shingles"))
    own = sparkutil.table(own.join(first.select("key", "sketches"), "key"), "bucket-shingles")

    zero, block = F.lit(0), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    lone = met.filter("blocks = 1").select("key", "number", "bucket", zero.alias("block"), zero.alias("first"), zero.alias("second"), F.lit(True).alias("skip"))
    big = met.filter("blocks > 1")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("number"))  # 16 rows of a key at most
    dealt = big.withColumn("_n", nth).filter(F.col("_n") <= PIVOTS).select("key", "number", "bucket", block.alias("block"), block.alias("first"), block.alias("second"), F.lit(False).alias("skip"))
    each = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block")
    pivots = big.select("number", "bucket", "blocks", "pivot").distinct().select(F.col("pivot").alias("key"), "number", "bucket", each)
    dealt = dealt.unionByName(pivots.select("key", "number", "bucket", "block", F.col("block").alias("first"), F.col("block").alias("second"), F.lit(False).alias("skip"))).distinct()
    links = _work(lone.unionByName(dealt).withColumn("root", F.lit(None).cast("binary")), own, "links")
    if big.isEmpty():
        return links

    # buckets over the bound whose members aren't all connected by now
    roots = components(links).select(F.col("node").alias("key"), "root")
    rooted = sparkutil.table(big.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "bucket-roots")
    parts = rooted.groupBy("number", "bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("number", "bucket")
    left = rooted.join(sparkutil.small(sparkutil.table(parts, "bucket-parts")), ["number", "bucket"]).select("key", "root").distinct()
    left = sparkutil.table(left, "unconnected")
    return links.unionByName(_rare_links(left, own))


def _rare_links(left: DataFrame, own: DataFrame) -> DataFrame:
    """Links between texts of different components, wherever two of them share rare shingles.

    In any one order of all shingles, texts of similarity 0.8 share one of the first fifth (and one) of their own.  The
    order taken begins with the shingles that only one component has, which lead to no other, and goes on with the
    rarest: so a text of which a fifth is its component's own meets no other, and else few share what it has left.
    """
    rows = sparkutil.table(own.select("key", "shingles").join(left, "key"), "unconnected-shingles")
    flat = rows.select("key", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    several = flat.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("shingle", "df")
    several = sparkutil.small(sparkutil.table(several, "several-have"))
    by_key = Window.partitionBy("key")
    placed = flat.join(several, "shingle").withColumns({"_place": F.row_number().over(by_key.orderBy("df", "shingle")), "_several": F.count("*").over(by_key)})
    first = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1  # of them n - _several are the component's own
    members = placed.filter(F.col("_place") <= first - (F.col("n") - F.col("_several"))).select("key", "root", "n", F.col("shingle").cast("long").alias("bucket"))
    members = sparkutil.table(members, "rare-shingles")

    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("total"), *[F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"xor{k}") for k in (0, 1)])
    shared = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("_parts"), F.sum("rows").alias("all"), F.max("rows").alias("most"), F.sum("total").alias("total"), *[F.bit_xor(f"xor{k}").alias(f"xor{k}") for k in (0, 1)],
    ).filter("_parts > 1")
    # of shingles that the same texts have the first one
    same = F.struct("bucket", "main", "most", F.greatest(F.ceil(F.col("all") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    shared = shared.groupBy("all", "xor0", "xor1").agg(F.min(same).alias("s")).select("all", "s.*")
    shared = sparkutil.small(sparkutil.table(shared, "shared-shingles"))
    # blocks of the texts outside the largest component are numbered from 0, that component's go on after them
    met = members.join(shared, "bucket").withColumn("rest", (F.col("root") != F.col("main")) | (F.col("blocks") == 1))
    rest_blocks = F.when(F.col("blocks") == 1, 1).otherwise(F.ceil((F.col("all") - F.col("most")) / F.col("all") * F.col("blocks"))).cast("int")
    met = met.withColumn("_r", rest_blocks)
    met = met.withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("key"), F.col("_r"))).otherwise(F.col("_r") + F.pmod(F.xxhash64("key"), F.col("blocks"))).cast("int"))
    last = F.when(F.col("blocks") == 1, 0).when(F.col("rest"), F.col("_r") + F.col("blocks") - 1).otherwise(F.col("_r") - 1)
    met = met.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    units = met.select("key", F.lit(SKETCHES).alias("number"), "bucket", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.lit(False).alias("skip"))
    return _work(units, own, "more-links")


def _work(units: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """Links found in units: (key, number, bucket, block, first, second, skip, root), with the members' shingles joined on.

    A null root says that nothing is connected yet.
    """
    units = units.withColumn("unit_hash", F.xxhash64("number", "bucket", "first", "second")).join(own, "key")
    rows = units.repartition("unit_hash").sortWithinPartitions(*_UNIT).select(*_UNIT, "key", "block", "skip", "root", "sketches", "shingles")
    return sparkutil.table(rows.mapInArrow(_link_units, "a binary, b binary").distinct(), name)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), the root being the smallest node of its component.

    Each round hooks every node to the smallest node next to it, jumps pointers, and contracts the links; the
    links that are left shrink at least by half in each round.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b")
    roots: DataFrame | None = None
    while True:
        links = sparkutil.table(links.distinct(), "component-links")
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = sparkutil.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "component-hooks")
        while True:  # pointer jumping until every pointer ends at a root
            up = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = sparkutil.table(hook.join(up, hook["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "component-hooks")
            moved = not jumped.filter("moved").isEmpty()
            hook = jumped.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots = hook
        else:
            up = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            roots = roots.join(up, roots["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
        to = lambda c: hook.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_{c}r"))
        links = links.join(to("a"), F.col("a") == F.col("_a")).join(to("b"), F.col("b") == F.col("_b"))
        links = links.select(F.least("_ar", "_br").alias("a"), F.greatest("_ar", "_br").alias("b")).filter("a < b")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return sparkutil.table(roots, "components")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, ``key`` and ``root`` (of the class; null for a null text) of each row."""
    found = components(find_links(docs))
    near = sparkutil.small(found)
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"))
    return rows.join(near, rows["key"] == near["node"], "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, and kept (one row of each class)."""
    rows = sparkutil.table(classes(docs), "classes")
    size = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_class"), F.count("*").alias("_size")).filter("_size > 1")
    size = sparkutil.table(size, "class-sizes")
    size = sparkutil.small(size)
    out = rows.join(size, "root", "left")
    class_id = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_class"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (nulls last), then of the smallest text key."""
    rows = sparkutil.table(classes(docs).filter("root IS NOT NULL"), "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    groups = rows.groupBy("root").agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = sparkutil.table(groups, "class-best")
    few = sparkutil.small(groups)
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    marked = rows.join(few, "root").select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), is_best.alias("_best"))
    # rows that go, and the few best rows that are there more than once
    counted = sparkutil.table(marked.groupBy("_id", "_k").agg(F.first("_best").alias("_best"), F.count("*").alias("_n")).filter("NOT _best OR _n > 1"), "class-drops")
    drop = sparkutil.small(counted)
    same = docs["doc_id"].eqNullSafe(drop["_id"]) & (_key(docs["text"]) == drop["_k"])
    kept = docs.join(drop, same, "left_anti")
    twice = counted.filter("_best")
    if twice.isEmpty():
        return kept
    twice = sparkutil.small(twice)
    again = docs.join(twice, docs["doc_id"].eqNullSafe(twice["_id"]) & (_key(docs["text"]) == twice["_k"]), "left_semi")
    return kept.unionByName(again.dropDuplicates(["doc_id", "text"]))
