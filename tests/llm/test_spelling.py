"""Spelling variants against brute force over all pairs, with small and with crowded buckets."""

import random
import zlib

import duckdb
import pytest

from corpuslens.llm import spelling
from tests.llm.conftest import SCHEMA, row


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    form, many = {}, {}
    for w in words:
        found = [x for x in words if near(w, x)]
        many[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, words[w], many[w], words[form[w]] if form[w] else None))
    return out


def vocabulary(rng):
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abeérstn") for _ in range(rng.randint(7, 11)))
        words[w] = rng.choice([2, 3, 40, 500, 9000])
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abeérstnÿ")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            if len(v) >= 7:
                words[v] = rng.choice([2, 3, 40, 500])
    for a in "abcdefgh":  # differ in their middle only
        for b in "abcdefgh":
            words[f"prefix{a}{b}suffix"] = words[f"prefix{a}suffix"] = 4
    words |= {"aaaaaaa": 2, "aaaaaaaa": 2, "aaaaaaaaa": 30, "a" * 3000: 5, "a" * 3001: 70}
    return words


def rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("split", [1, 3, spelling.SPLIT])
def test_variants_equal_brute_force(spark, split):
    words = vocabulary(random.Random(3))
    df = spark.createDataFrame([*words.items()], "word string, n long").withColumnRenamed("n", "n")
    got = rows(spelling.group_variants(df, split=split))
    assert len(got) == len(words) and set(got) == brute(words)


def test_every_pair_once(spark):
    words = vocabulary(random.Random(8))
    df = spark.createDataFrame([*words.items()], "word string, n long")
    for split in (1, 256):
        got = [tuple(sorted((r["word"], r["near"]))) for r in spelling.near_pairs(df, split).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_forms_are_followed(spark):
    df = spark.createDataFrame([("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("abcdefghijk", 20000), ("zzzzzzz", 3)], "word string, n long")
    assert {r[0]: r[2] for r in rows(spelling.group_variants(df))} == {w: "abcdefghijk" for w in ("abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk")} | {"zzzzzzz": "zzzzzzz"}


def test_lossy_words(spark):
    texts = {i: " ".join(f"Straße{'xyz'[k % 3]}n{'abc' * (k % 4)}é÷Ä" for k in range(9)) for i in range(60)}
    want = []
    for i, text in texts.items():
        for run in text.split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run)
    got = [r[0] for r in spelling.lossy_words(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and len(set(want)) > 12


def test_odd_rows(spark, odd, odd_rows, none):
    assert rows(spelling.variants_of_documents(none)) == []
    got = rows(spelling.variants_of_documents(odd))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in odd_rows])
    assert sorted(got, key=repr) == sorted(con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.SQL})").fetchall(), key=repr)


def test_repeated_rows_are_occurrences(spark):
    df = spark.createDataFrame([row(1, "Wonderful"), row(1, "Wonderful"), row(2, None), row(3, "short")], SCHEMA)
    assert [r[0] for r in rows(spelling.variants_of_documents(df))] == ["wonderful"]
