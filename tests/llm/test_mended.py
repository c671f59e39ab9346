"""Cases that operators once got wrong or paid too much for."""

import random

import pytest
from tokenizers import Tokenizer

from corpuslens.llm import decontamination, packing, sparkutil


def test_ids_of_unicode_texts():
    tok = Tokenizer.from_file(packing.default_tokenizer())
    counter = packing.ChunkTokenizer(packing.default_tokenizer())
    rng = random.Random(2)
    kinds = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x250, 0x600), range(0x1E00, 0x2100), range(0x3040, 0x3100), range(0x4E00, 0x4E40), range(0xAC00, 0xAC40), range(0xFB00, 0xFB07), range(0x1F600, 0x1F620)]
    texts = ["BELEDİYESİ, İstanbul. İ, i̇, ŉ, ǰ. ß, ẞ. Σ, ΟΔΟΣ, ΟΔΟΣ. ﬁ, ½, x., y,. ,.", "Ä, Ö. Ü,", "Á, é. ñ,"]
    for _ in range(1500):
        kind = rng.choice(kinds)
        texts.append("".join(chr(rng.choice(rng.choice([kind, kinds[0]]))) if rng.random() < 0.8 else rng.choice(" ,.'İ") for _ in range(rng.randint(1, 30))))
    for t, ids in zip(texts, counter.ids(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="tokenizer"):
        packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written."""
    rows = {}
    real = sparkutil.table

    def table(df, name, lasting=False):
        out = real(df, name, lasting)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(sparkutil, "table", table)
    return rows


def test_repetitive_text_against_many_items(spark, written):
    docs = spark.createDataFrame([(1, "again and " * 4000), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "again and " * (20 + i)) for i in range(200)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (8000, 8000, 200, True)
    assert (got[2]["n_hit"], got[2]["n_items"], got[2]["contaminated"]) == (0, 0, False)
    assert written["window-hits"] <= 8000 and written["set-members"] <= 400


def test_passage_that_many_items_share(spark, written):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, passage + " own words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"item{i} {passage}") for i in range(60)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in (1, 2)] == [(1000, 60)] * 2
    assert written["window-hits"] <= 2 * 1000 and written["set-members"] <= 2 * 60


def test_insertions_write_paths_of_the_tree():
    from corpuslens.llm import token_counts

    counter = token_counts.PretokenCounter(token_counts.default_tokenizer())
    text = " ".join(f"word{i % 700}" for i in range(50_000))
    tree = token_counts.build(text, counter)
    nodes = 2 * tree.slots
    rng = random.Random(3)
    for _ in range(10):
        text, tree = token_counts.edit(text, tree, rng.randrange(len(text)), 0, " inserted", counter)
    assert tree.written < 10 * 40 < nodes / 5
    assert tree.total().tolist() == token_counts.build(text, counter).total().tolist()


def test_many_edits_of_a_long_text():
    from corpuslens.llm import token_counts

    counter = token_counts.PretokenCounter(token_counts.default_tokenizer())
    rng = random.Random(4)
    text = " ".join(f"w{i % 90}" for i in range(20_000))
    tree = token_counts.build(text, counter)
    for k in range(400):  # mostly at one place, so that its leaves overflow again and again
        at = 5000 if k % 4 else rng.randrange(len(text))
        text, tree = token_counts.edit(text, tree, at, rng.choice([0, 0, 0, 40, 3000 if k % 50 == 9 else 1]), rng.choice(["", " new words here", " a b c d e f g h" * 30]), counter)
        if k % 40 == 39:
            whole = token_counts.build(text, counter)
            assert tree.total().tolist() == whole.total().tolist()
            assert tree.nodes[1:tree.slots].tolist() == (tree.nodes[2 : 2 * tree.slots : 2] + tree.nodes[3 : 2 * tree.slots : 2]).tolist()
    assert tree.slots <= 8 * whole.slots


def boilerplate_texts(n, rng, shared=65, own=35):
    """Texts that share most of their words and are no near copies, and a near copy of every tenth."""
    common = " ".join(f"common{i}" for i in range(shared))
    texts = []
    for i in range(n):
        mine = [f"own{rng.randrange(10**7)}" for _ in range(own)]
        texts.append((i, f"{common} {' '.join(mine)}"))
        if i % 10 == 0:
            mine[-1] = "changed"
            texts.append((n + i, f"{common} {' '.join(mine)}"))
    return texts


def test_unlike_texts_of_one_boilerplate(spark, written):
    from corpuslens.llm import minhash_dedup

    texts = boilerplate_texts(1500, random.Random(12))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, i if i < 1500 else i - 1500) for i, _ in texts}
    # what all have isn't among the rarest
    assert written["rare-shingles"] <= 40 * len(texts)


def test_near_copies_that_rare_shingles_find(spark):
    """Many alike texts that sketches join in large buckets; all links against brute force."""
    from corpuslens.llm import minhash_dedup

    rng = random.Random(21)
    texts = []
    for i in range(500):
        common = [f"c{k}" for k in range(70)]
        for k in rng.sample(range(70), 2):
            common[k] = f"x{rng.randrange(3)}"
        texts.append((i, " ".join(common + [f"own{rng.randrange(4)}z{k}" for k in range(12)])))

    def gram(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [gram(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    want = {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
    got = {}
    for r in minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
