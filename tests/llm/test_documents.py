"""Near-duplicates, packing, token counts, decontamination, sharding and chat formatting."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from corpuslens.llm import chat_format, decontamination, minhash_dedup, packing, sharding, sparkutil, token_counts
from tests.llm import recall_near_duplicates
from tests.llm.conftest import SCHEMA, prose, row


def lower_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = lower_words(t)
        sets.append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) if t is not None else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            a, b = sets[i], sets[j]
            if same or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return sorted(sorted(map(repr, g)) for g in groups.values())


def near_corpus():
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 200)).split()
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(["", "", None, None, "one two", "One two!", "!!", "..."])]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_corpus()
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(map(repr, g)) for g in groups.values()) == brute_classes(rows)
    assert all(min(g) == c for c, g in groups.items())
    assert all(r.class_size == len(groups[r.class_id]) and r.kept == (r.doc_id == r.class_id) for r in got)


def test_blocks_give_the_same_classes(spark, monkeypatch):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, minhash_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, minhash_dedup.near_duplicates(df).collect())) == whole


def drifting_corpus():
    """Chains in which each text is near to the next one only, a large group of near copies, and stragglers of it."""
    rng = random.Random(12)
    texts = []
    for _ in range(2):
        words = prose(rng, 80).split()
        for _ in range(25):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    base = prose(rng, 120).split()
    for i in range(90):
        words = list(base)
        for _ in range(1 if i % 6 else rng.choice([2, 3, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rows = drifting_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = brute_classes(rows)
    for block, pivots in ((200, 4), (4, 4), (3, 1)):
        monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", block)
        monkeypatch.setattr(minhash_dedup, "PIVOTS", pivots)
        groups = defaultdict(list)
        for r in minhash_dedup.near_duplicates(df).collect():
            groups[r.class_id].append(r.doc_id)
        assert sorted(sorted(map(repr, g)) for g in groups.values()) == expect


def test_recall_against_all_pairs(spark):
    """Every text of a table against all of its rows."""
    found = recall_near_duplicates.measure(spark, "/root/testdata/sf0.01", every=1)
    assert found["pairs"] > 20 and found["found"] >= 0.99 * found["pairs"]


def test_keep_one(spark, odd, none):
    kept = minhash_dedup.keep_one(odd)
    assert kept.schema == odd.schema
    ids = sorted(repr(r.doc_id) for r in kept.collect())
    # 5, 5 and 6 are the same text; null texts stay
    assert ids == sorted(map(repr, [1, 2, 3, None, 4, 5, 7, 8, 9, None, 10, 11]))
    assert minhash_dedup.keep_one(none).count() == 0 and minhash_dedup.near_duplicates(none).count() == 0
    rows = near_corpus()
    left = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == len(brute_classes(rows))


def test_alignment_follows_order():
    a = np.arange(100, dtype=np.uint32)
    assert minhash_dedup.aligned(a, a)
    assert minhash_dedup.aligned(a, np.delete(a, [3, 50, 77]))
    assert not minhash_dedup.aligned(a, np.concatenate([a[50:], a[:50]]))
    assert not minhash_dedup.aligned(a, np.concatenate([a[:70], a[70:] + 1000]))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    expect = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert got == expect


def test_packing_round_trip(spark, odd, odd_rows, none):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(odd, with_ids=True).collect()
    whole = defaultdict(list)
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert r.length == len(ids) <= 2048 and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.start == 2048 * r.piece
        whole[repr(r.doc_id)].append((r.piece, r.ids))
    expect = defaultdict(list)
    for r in odd_rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        expect[repr(r[0])] += [(p, ids[p * 2048 : (p + 1) * 2048]) for p in range(-(-len(ids) // 2048))]
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in expect.items()}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    for lengths in (rng.lognormal(6, 1, 20000).astype(int).clip(1, 2048), rng.integers(1, 60, 5000), np.full(3000, 700), np.array([2048, 2048, 1])):
        have = np.bincount(lengths, minlength=2049)
        plan = packing.make_plan(have)
        rank = np.concatenate([np.arange(n) for n in have[have > 0]])
        size = np.repeat(np.arange(2049), have)
        seq, offset = plan.place(size, rank)
        order = np.lexsort((offset, seq))
        end = (offset + size)[order]
        first = np.diff(seq[order], prepend=-1) != 0
        assert (offset[order] == np.where(first, 0, np.roll(end, 1))).all() and end.max() <= 2048
        assert plan.sequences == len(np.unique(seq))
        bound = max(-(-int(size.sum()) // 2048), (size > 1024).sum(), -(-len(size) // (2048 // size.min())))
        if (lengths == 700).all():
            bound = 1500
        assert plan.sequences <= 1.01 * bound + 1


def test_counts_after_edits_equal_full_encoding():
    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    tok.encode_special_tokens = True
    counter = token_counts.PretokenCounter(token_counts.default_tokenizer())
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(" \n\t  ab'sd12.,!é日<|endoftext|>") for _ in range(rng.choice([0, 1, 5, 50, 400, 1500])))
        tree = token_counts.build(text, counter)
        for _ in range(3):
            text, tree = token_counts.edit(text, tree, rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 30, 500]), rng.choice(["", "  ", "\n", "'s", "abc" * 60, " x", "é 12"]), counter)
            total = tree.total()
            assert total[0] == len(text) and total[1] == len(counter.pattern.findall(text))
            assert total[2] == len(tok.encode(text, add_special_tokens=False).ids)


def test_edits_touch_little(spark):
    d = spark.createDataFrame([(1, "word " * 5000)], "doc_id long, text string")
    r = token_counts.count_edited(d).first()
    assert r.n_tokens == 5001 and r.reencoded < 400


def test_token_count_edge_cases(odd, none, odd_rows):
    tok = Tokenizer.from_file(token_counts.default_tokenizer())
    tok.encode_special_tokens = True
    got = sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.count_edited(odd).collect())
    assert got == sorted((repr(r[0]), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert token_counts.count_edited(none).count() == 0
    trees = token_counts.build_trees(odd.filter("doc_id IN (1, 2)"))
    from pyspark.sql import functions as F

    edited = token_counts.apply_edits(trees.withColumn("edits", F.lit(None))).collect()
    assert {r.doc_id: (r.text or "") for r in edited} == {r[0]: r[1] or "" for r in odd_rows if r[0] in (1, 2)}


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same_rows(df, sql, **tables):
    names, rows = run_sql(sql, **tables)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, rows))


def test_decontamination_equals_sql(spark, odd, none):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [row(1, text), row(2, text.upper()), row(3, None), row(4, ""), row(5, "a b c"), row(5, "a b c"), row(6, "x " * 20), row(None, text), row(7, "É é K k A "),
         row(8, " ".join(f"w{i}" for i in range(10, 22))), row(9, "q " + " ".join(f"w{i}" for i in range(10, 24)) + " z!"), row(10, "..."), row(11, "lorem ipsum dolor " * 500 + text)],
        SCHEMA,
    )
    items = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, "b c", ""), (3, "x " * 14, ""), (4, None, ""), (5, "!!", ""), (None, "É é", ""), (6, "a", ""), (1, "extra b c d e f g h i j k l m n o p", "")], "item_id long, text string, place string")
    empty = spark.createDataFrame([], "item_id long, text string")
    same_rows(decontamination.decontaminate(docs, items), decontamination.SQL, documents=docs, benchmark=items)
    same_rows(decontamination.decontaminate(docs, empty), decontamination.SQL, documents=docs, benchmark=empty)
    same_rows(decontamination.decontaminate(odd, items), decontamination.SQL, documents=odd, benchmark=items)
    assert decontamination.decontaminate(none, items).count() == 0
    kept = decontamination.remove_contaminated(docs, items)
    clean = [r.doc_id for r in decontamination.decontaminate(docs, items).filter("NOT contaminated").collect()]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, clean)) and kept.schema == docs.schema


def test_case_folding_hides_no_hit(spark):
    """Words are equal by A-Z only, whatever full lower-casing makes of sigma, dotted I, sharp S and the Kelvin sign."""
    docs = spark.createDataFrame(
        [(1, "x ΟΔΟΣ.Α y"), (2, "x ΟΔΟΣ Α y"), (3, "ΟΔΟΣ"), (4, "x ΟΔΟΣ'ΑΒ y"), (5, "a İstanbul'da b"), (6, "a \u212aelvin b kelvin"), (7, "STRASSE STRAẞE straße"), (8, "i̇stanbul da"), (9, " ".join(["ΣΑΣ"] * 20)), (10, ".".join(["ΣΑΣ"] * 20))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, "ΟΔΟΣ Α"), (8, "ΟΔΟΣ ΑΒ"), (9, "İstanbul-DA"), (10, "\u212aELVIN"), (11, "STRAẞE"), (12, "ΣΑΣ " * 14)], "item_id long, text string")
    same_rows(decontamination.decontaminate(docs, items), decontamination.SQL, documents=docs, benchmark=items)
    found = {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(docs, items).collect()}
    assert found == {1: 2, 2: 2, 3: 0, 4: 2, 5: 2, 6: 1, 7: 1, 8: 0, 9: 20, 10: 20}


def test_repeated_phrases_and_many_short_items(spark):
    rng = random.Random(6)
    phrase = prose(rng, 15)
    docs = spark.createDataFrame([(i, " ".join([prose(rng, 5, 30), phrase] * (1 + 40 * (i % 2)) + ["x"] * 300 * (i % 3))) for i in range(12)], "doc_id long, text string")
    items = [(k, " ".join(["x"] * 30)) for k in (100, 101)] + [(200, f"{phrase} {phrase} {phrase}"), (201, phrase)] + [(k, prose(rng, k, 30)) for k in range(1, 13)] + [(20 + k, " ".join(phrase.split()[:k])) for k in range(1, 13)]
    items = spark.createDataFrame(items, "item_id long, text string")
    same_rows(decontamination.decontaminate(docs, items), decontamination.SQL, documents=docs, benchmark=items)


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 16)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 150, 6)) for i in range(12)], "doc_id long, text string")
    items = docs.selectExpr("doc_id AS item_id", "substring(text, 100, 120) AS text")
    same_rows(decontamination.decontaminate(docs, items), decontamination.SQL, documents=docs, benchmark=items)


def test_chat_digests_equal_sql(spark):
    m = chat_format.MARK
    rows = [(1, 0, "user", f"<s>a<{m}s>[INST]{m}"), (1, 1, "assistant", f"[{m}{m}/INST]</s></s>"), (1, 2, None, None), (2, 0, "weird [TEXT] r", "x [TEXT] y [/ROLE]"), (2, None, "user", ""), (None, 1, "assistant", "\n\n"),
            (3, 0, "user", "a<"), (3, 0, "user", "a<"), (4, 1, "", " "), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same_rows(chat_format.conversation_digests(spark, df), chat_format.digests_sql(), conversations=df)
    empty = spark.createDataFrame([], df.schema)
    same_rows(chat_format.conversation_digests(spark, empty), chat_format.digests_sql(), conversations=empty)
    out = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert out[5].valid and not out[1].valid and not out[3].valid
    assert [s.loss for s in out[5].segments] == [False] * 7 + [True, False]
    plain = "".join(s.text for s in out[5].segments)
    assert plain.startswith("[SYS] s [/SYS]\n[INST] u [/INST]<s>long")


def test_escaping_hides_controls_and_is_undone(spark):
    rng = random.Random(4)
    t = chat_format.Template()
    alphabet = [*t.controls, chat_format.MARK, "<", "[", "s>", "a", "\n"]
    rows = [("".join(rng.choice(alphabet) for _ in range(12)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string")
    from pyspark.sql import functions as F

    for r in df.select("x", chat_format.escape(F.col("x"), t).alias("e")).withColumn("u", chat_format.unescape(F.col("e"), t)).collect():
        assert r.u == r.x and not any(c in r.e for c in t.controls)


def test_sharding_law(spark, odd, none, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(1500)] + [(2000 + i, "hot copy of one text") for i in range(700)] + [(None, None), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_law(df).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got) + 0.03 * sum(size.values()) / 24
    assert sharding.shard_law(odd).count() == odd.count() and sharding.shard_law(none).count() == 0
    sharding.write_shards(df, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, (tuple(r) for r in back.select("doc_id", "text").collect()))) == sorted(map(repr, rows))


def test_written_shards_hold_whole_rows(spark, none, tmp_path):
    rows = [(1, "a b", "en", "s1", 5, 9), (1, "a b", "de", "s2", 6, 8), (2, None, "fr", "s3", None, 7), (2, "", "it", "s3", 0, 6), (None, "x", "x", "x", 1, 1), (None, "x", "x", "x", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, slot int")
    path = str(tmp_path / "odd")
    name = sharding.write_shards(df, path, 3)
    assert name == "_shard"
    back = spark.read.parquet(path)
    assert sorted(map(repr, (tuple(r) for r in back.select(*df.columns).collect()))) == sorted(map(repr, rows))
    assert sharding.write_shards(none, str(tmp_path / "none")) == "shard"
    # files of a shard in the order of their names give the slots
    many = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sharding.write_shards(many, str(tmp_path / "many"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "many" / "shard=0").glob("*.parquet"))
    ids = [r for f in files for r in pq.read_table(f, partitioning=None).column("doc_id").to_pylist()]
    expect = [r.doc_id for r in sharding.assign(many, 2).filter("shard = 0").orderBy("slot").collect()]
    assert len(files) > 1 and ids == expect


def test_cuts_equal_an_independent_count(spark):
    """Shards from the written order alone: rows in order of (shard, slot) are cut where their middles pass equal parts of all bytes."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(1200)] + [(5000 + i, "one text that comes often") for i in range(300)] + [(9000, "z" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for slack in (0.0, sharding.SLACK):
        got = sharding.assign(df, 24, slack).orderBy("shard", "slot").collect()
        size = {i: len(t.encode()) + 8 for i, t in rows}
        total, at, groups = sum(size.values()), 0, defaultdict(set)
        assert sorted(r.doc_id for r in got) == sorted(size)
        for r in got:
            cut = min(23, int((at + size[r.doc_id] // 2) * 24 // total))
            at += size[r.doc_id]
            assert r.size == size[r.doc_id] and (r.shard == cut or slack and abs(r.shard - cut) == 1), (r, cut)
            groups[r.text_hash].add(r.shard)
        places = [r.text_hash for r in got]
        assert all(places[i] <= places[i + 1] for i in range(len(places) - 1))  # equal texts lie side by side
        if slack:  # a text's copies are divided only if they are more than the slack
            heavy = {h for h in groups if sum(r.size for r in got if r.text_hash == h) > slack * total / 24}
            assert all(len(s) == 1 for h, s in groups.items() if h not in heavy)


def test_copies_with_one_id_fill_many_ranges(spark):
    df = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one text' AS text")
    got = sharding.shard_law(df).collect()
    count = Counter(r.shard for r in got)
    assert len(count) == 24 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())


def test_conversations_with_text_ids(spark):
    df = spark.createDataFrame([("a", "0", "user", "x"), ("a", "1", "assistant", "y"), ("7", "z", "user", "<s>")], "conv_id string, turn string, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat_format.conversation_digests(spark, df).collect()}
    assert got == {"a": 2, "7": 1, "-1": 2}


def test_intermediate_tables(spark):
    kept = sparkutil.table(spark.range(3), "kept")
    with sparkutil.scratch():
        gone, lasting = sparkutil.table(spark.range(3), "gone"), sparkutil.table(spark.range(4), "lasting", lasting=True)
        assert gone.count() == 3
    folder = sparkutil.shared_dir(spark).removeprefix("file:")
    names = [p.name for p in Path(folder).iterdir()]
    assert not any("-gone-" in n for n in names) and any("-kept-" in n for n in names)
    assert kept.count() == 3 and lasting.count() == 4


def test_hash_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
