"""What round 4 mended: rows of blocks in the stored index, paths of Han runs, whole query sets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import index, index_store, search, segment
from corpuslens.plans.query_set import ORACLE_SQL, QUERIES

FIELDS = {"content": "text"}


def brute(spark, texts, query, k):
    posts = index.postings(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), FIELDS, "doc_id")
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.top(search.bm25(posts, query, "doc_id"), k, "doc_id").collect())


def test_postings_are_rows_of_blocks(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "index")
    texts = {i: " ".join(rng.choices([f"w{j}" for j in range(150)], k=60)) for i in range(600)}
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").coalesce(4)
    index_store.write_segment(rows, path, 0, FIELDS, buckets=4)
    index_store.merge(spark, path, f"{path}-merged", buckets=4)
    for where in (path, f"{path}-merged"):
        posts = spark.read.parquet(f"{where}/postings").filter("term <> ''")
        assert posts.groupBy("term", "field", "block").count().filter("count > 1").isEmpty()
        flat = {(r.term, r.doc_id, r.tf) for r in posts.select("term", F.explode("docs").alias("d")).select("term", "d.*").collect()}
        assert flat == {(w, i, n) for i, text in texts.items() for w, n in Counter(text.split()).items()}
        assert index_store.wrote(spark, where, 0) == (600, len(flat))


@pytest.mark.parametrize("size", [3, 90])
def test_merge_of_blocks_that_lost_documents(spark, tmp_path, size):
    """Blocks that have few documents left are put together, others stay; lost documents are lost in both."""
    rng, path, words = random.Random(size), str(tmp_path / "index"), [f"w{j}" for j in range(40)]
    now = {}
    for number in range(4):
        new = {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(number * (size - 1), number * (size - 1) + size)}
        now |= new
        rows = spark.createDataFrame([*sorted(new.items())], "doc_id long, text string")
        index_store.write_segment(rows, path, number, FIELDS, buckets=4)
    index_store.merge(spark, path, f"{path}-merged", buckets=4)
    docs, posts = (spark.read.parquet(f"{path}-merged/{name}") for name in ("documents", "postings"))
    assert docs.count() == len(now) and (size == 90 or docs.select("block").distinct().count() == 1)
    known = docs.select("doc_id", F.col("block").alias("own"))
    assert posts.filter("term <> ''").select("block", F.explode("docs.doc_id").alias("doc_id")).join(known, "doc_id").filter("block <> own").isEmpty()
    query = spark.createDataFrame([(q, w) for q in range(5) for w in {*rng.choices(words, k=3), "none"}], "query_id long, term string")
    for where in (path, f"{path}-merged"):
        got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in index_store.topk(spark, where, query, 4, buckets=4).collect())
        assert got == brute(spark, now, query, 4)


@pytest.mark.parametrize(("one_by_one", "table"), [(0, 1 << 22), (2, 8), (16, 1 << 22)])
def test_many_runs_are_cut_like_one(monkeypatch, one_by_one, table):
    """The same words as by ``best_path``, and the same counts as by plain counting."""
    monkeypatch.setattr(segment, "ONE_BY_ONE", one_by_one)
    monkeypatch.setattr(segment, "TABLE", table)
    rng = random.Random(one_by_one)
    for longest in (1, 2, 3, 4, 5):
        words = ["".join(rng.choices("天地人山水", k=k)) for k in range(1, longest + 1) for _ in range(12)]
        costs = {w: rng.choice([1.0, 2.0, 2.5, 4.0, rng.random()]) for w in words}
        run = lambda: "".join(rng.choices("天地人山水𠀀", k=rng.choice([1, 2, 5, 30, 90])))
        texts = [" ".join(run() for _ in range(rng.randint(1, 6))) for _ in range(15)]
        want = [" ".join(" ".join(segment.best_path(r, costs, max(map(len, costs)), 14.0)) for r in t.split(" ")) for t in texts]
        assert segment.Cutter(costs, 14.0)(texts) == want
        got = {w: n for found in segment._count(texts, longest) for w, n in zip(*found, strict=True)}
        assert got == Counter(r[i : i + k] for t in texts for r in t.split(" ") for k in range(1, longest + 1) for i in range(len(r) - k + 1))


def test_runs_are_looked_for_once_for_a_cut(spark):
    """A text's Han runs went to Python by a condition that looked for them again."""
    lexicon = spark.createDataFrame([("天地", 9, 1.0), ("人", 9, 1.0)], "word string, n long, cost double")
    rows = spark.createDataFrame([(1, "天地人x"), (2, "plain"), (3, None)], "i int, text string")
    cut = rows.select("i", segment.terms(lexicon)("text").alias("w"))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.split("ArrowEvalPython", 1)[1].count("regexp_extract_all") == 1
    assert {r.i: r.w for r in cut.collect()} == {1: ["天地", "人", "x"], 2: ["plain"], 3: []}


def test_long_runs_cost_no_more_than_short_ones():
    """A run of 300,000 characters; it was quadratic to count, and is cut in one piece."""
    rng = random.Random(9)
    text = "".join(rng.choices("天地人山水火木", k=300_000))
    (one, _), (two, n) = segment._count([text], 2)
    assert len(one) == 7 and sum(n) == len(text) - 1
    words = segment.Cutter({w: 1.0 for w in two} | {w: 2.0 for w in one}, 9.0)([text])[0].split(" ")
    assert "".join(words) == text and len(words) == 150_000


@pytest.mark.parametrize("name", ["bm25_topk", "chunk_search", "keyword_search"])
def test_every_item_is_asked(spark, name):
    """A search took every twentieth benchmark item for its queries, in code and SQL."""
    assert "% 20" not in ORACLE_SQL[name]
    items = {r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("trim(text) <> ''").collect()}
    got = QUERIES[name](spark, "/root/testdata/sf0.001").groupBy("query_id").agg(F.max("rank").alias("most")).collect()
    assert {r.query_id for r in got} == items if name != "keyword_search" else {r.query_id % 20 for r in got} > {0}
    assert max(r.most for r in got) == search.TOP_K or name == "keyword_search"
