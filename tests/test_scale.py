"""Steps whose cost must not grow faster than their input: what their plans leave out, and the same results."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import graph, index_store, search, vector_index
from corpuslens.plans.query_set import QUERIES
from jobs import index_documents

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "shuffles"), [("graph_edges", 1), ("graph_nodes", 1), ("evidence_detail", 2)])
def test_evidence_is_decided_inside_its_chunk(spark, name, shuffles):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") <= shuffles and "Window" not in plan
    # evidence text is prepared outside of the lambda that looks for quotes in it
    assert "Contains(regexp_replace" not in plan


def test_rows_of_a_chunk_meet(spark):
    node = lambda n, q: {"name": n, "type": "t", "quote": q, "confidence": 0.5}
    edge = lambda a, b, q: {"source": a, "target": b, "type": "uses", "quote": q, "confidence": 1.0}
    first = {"nodes": [node("Alpha", "alpha"), node("Ａlpha", "alpha"), node("Beta", "nowhere")], "edges": [edge("beta", "ALPHA", "beta"), edge("alpha", "beta", "beta"), edge("alpha", "beta", "beta")]}
    second = {"nodes": [node("Beta", "beta"), node("Gamma", None)], "edges": [edge("gamma", "beta", "alpha")]}
    rows = [("c", 1, "Alpha, Beta", json.dumps(p)) for p in (first, second)]
    parsed = graph.parse_extractions(spark.createDataFrame(rows, "chunk_id string, document_id long, content string, extraction_json string"))
    nodes, edges, evidence = graph.merge(parsed)
    assert {r.canonical: r.mention_count for r in nodes.collect()} == {"alpha": 2, "beta": 2, "gamma": 1}
    assert sorted((r.a_name, r.b_name, r.mention_count) for r in edges.collect()) == [("alpha", "beta", 1), ("beta", "alpha", 1), ("gamma", "beta", 1)]
    assert evidence.groupBy("canonical", "quote").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def test_search_cuts_texts_once(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None), (4, "other words")], "doc_id long, text string")
    query = spark.createDataFrame([(1, "beta"), (1, "unknown")], "query_id long, term string")
    found = search.bm25_texts(rows, {"content": "text"}, query, "doc_id")
    assert "regexp_extract_all" not in plan_of(found)  # texts were cut when counts were written
    assert {r.doc_id for r in found.collect()} == {1, 2}


def test_terms_are_counted_in_their_row(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abcdeé词") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>").select("t", index_store._counted(F.col("t")).alias("c")).collect()
    assert all({x.term: x.tf for x in r.c} == Counter(r.t) and len(r.c) == len(set(r.t)) for r in rows)


def test_repeated_keys_of_a_batch(spark, tmp_path):
    rows = [(1, "alpha beta"), (1, "beta beta gamma"), (2, "alpha"), (3, None), (3, "late"), (None, "nobody")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    got = index_documents.run(spark, f"{tmp_path}/documents", f"{tmp_path}/index", f"{tmp_path}/checkpoint").collect()
    assert {(r.term, r.doc_id): r.tf for r in got} == {("beta", 1): 2, ("gamma", 1): 1, ("alpha", 2): 1, ("late", 3): 1}


def test_words_come_back_as_one_text(spark):
    assert "split(pythonUDF" in plan_of(QUERIES["segmented_postings"](spark, SF))


def test_queries_meet_their_lists_in_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<float>")
    query = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    vector_index.build(vectors, f"{tmp_path}/v", vector_index.train(vectors))
    monkeypatch.setattr(vector_index, "PAIRS", 7)  # fewer than there are lists: one query at a time
    rows = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert rows(vector_index.topk(spark, f"{tmp_path}/v", query, 5, probes=1, exact=True)) == rows(search.vector_topk(vectors, query, 5))
