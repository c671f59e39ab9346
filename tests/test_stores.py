"""The stored keyword index and the vector lists against searches without them."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import index, index_store, search, vector_index
from corpuslens.plans.query_set import QUERIES

SF = "/root/testdata/sf0.01"
FIELDS = {"content": "text", "title": "title"}


def corpus(rng, ids, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))) for i in ids]


def best(spark, rows, query, k):
    posts = index.postings(spark.createDataFrame(rows, "doc_id long, text string, title string"), FIELDS, "doc_id")
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.top(search.bm25(posts, query, "doc_id"), k, "doc_id").collect())


def test_index_after_adds_replacements_deletes_and_a_merge(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    path, k = str(tmp_path / "index"), 5
    now = {r[0]: r for r in corpus(rng, range(400), words)}
    query = spark.createDataFrame([(q, t) for q in range(12) for t in {*rng.choices(words, k=4), "w0", "unknown"}], "query_id long, term string")

    def check(where):
        got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in index_store.topk(spark, where, query, k).collect())
        assert got == best(spark, list(now.values()), query, k)

    def add(number, rows, gone=()):
        df = spark.createDataFrame([(*r, False) for r in rows] + [(g, None, None, True) for g in gone], "doc_id long, text string, title string, gone boolean")
        index_store.write_segment(df, path, number, FIELDS, gone="gone")
        now.update({r[0]: r for r in rows})
        for g in gone:
            del now[g]

    add(0, list(now.values()))
    check(path)
    add(1, corpus(rng, range(100, 180), words) + corpus(rng, range(400, 430), words), gone=range(0, 60))
    check(path)
    add(2, corpus(rng, range(10, 20), words), gone=[100, 101])  # some come back
    check(path)
    index_store.merge(spark, path, str(tmp_path / "merged"))
    check(str(tmp_path / "merged"))
    left = {(r.field, r.term, r.doc_id, r.tf) for r in index_store.live_postings(spark, path).collect()}
    assert left == {(r.field, r.term, r.doc_id, r.tf) for r in index.postings(spark.createDataFrame(list(now.values()), "doc_id long, text string, title string"), FIELDS, "doc_id").collect()}


def test_a_search_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha w"), F.col("id").cast("string")).alias("text"))
    index_store.write_segment(rows, path, 0, {"content": "text"})
    query = spark.createDataFrame([(1, "alpha")], "query_id long, term string")
    bucket = query.select(index_store.bucket_of("term")).first()[0]
    plan = index_store.topk(spark, path, query, 3)._jdf.queryExecution().toString()
    assert f"bucket IN ({bucket})" in plan or f"(bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert [r.doc_id for r in index_store.topk(spark, path, query, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_blocks_that_cannot_reach_the_bar_are_left_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 3 if i % 500 == 7 else "other words here and there"), "") for i in range(3000)]
    index_store.write_segment(spark.createDataFrame(rows, "doc_id long, text string, title string"), path, 0, FIELDS)
    query = spark.createDataFrame([(1, "common"), (1, "rare")], "query_id long, term string")
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in index_store.topk(spark, path, query, 4).collect())
    assert got == best(spark, rows, query, 4) and {r[2] % 500 for r in got} == {7}


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], "doc_id long, text string, title string")
    index_store.write_segment(none, path, 0, FIELDS)
    assert index_store.topk(spark, path, spark.createDataFrame([(1, "x")], "query_id long, term string"), 3).count() == 0
    index_store.write_segment(spark.createDataFrame([(1, None, ""), (2, " .", None)], none.schema), path, 1, FIELDS)
    assert index_store.live_postings(spark, path).count() == 0


def test_recall_of_the_vector_lists(spark):
    near = {(r.query_id, r.vec_id) for r in QUERIES["vector_ann_topk"](spark, SF).collect()}
    exact = {(r.query_id, r.vec_id) for r in QUERIES["vector_topk"](spark, SF).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("probes", [1, None])
def test_vector_lists_of_clusters_and_copies(spark, tmp_path, probes):
    rng = random.Random(1)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centers[i % 12]]) for i in range(1500)]
    rows += [(i, rows[5][1]) for i in range(1500, 2200)] + [(9000, None), (9001, [0.0] * 16)]  # a third are copies
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    query = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 1500, 20)] + [(7777, None), (7778, [0.0] * 16)], "query_id long, embedding array<double>")
    path = str(tmp_path / "vectors")
    vector_index.build(vectors, path, vector_index.train(vectors, sample=500))
    assert spark.read.parquet(f"{path}/vectors").count() == 2200
    want = {(r.query_id, r.rank, r.vec_id) for r in search.vector_topk(vectors, query, 10).collect()}
    assert {(r.query_id, r.rank, r.vec_id) for r in vector_index.topk(spark, path, query, 10, probes=probes, exact=True).collect()} == want
    found = {(r.query_id, r.vec_id) for r in vector_index.topk(spark, path, query, 10, probes=probes).collect()}
    if probes is None:
        assert len(found & {(q, v) for q, _, v in want}) >= 0.9 * len(want)


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = str(tmp_path / "vectors")
    vector_index.build(none, path, vector_index.train(none))
    assert vector_index.topk(spark, path, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>"), 3).count() == 0
