"""Queries over whole tables: nothing of the input is left out."""

import pytest

from corpuslens.operators import index, search
from corpuslens.plans.query_set import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("query, source", [("evidence_star", "lineitem"), ("scope_null_safe", "events"), ("queue_order", "events")])
def test_a_row_for_each_row(spark, query, source):
    assert QUERIES[query](spark, SF).count() == rows_of(spark, source).count()


def test_terminal_split_counts_all_runs(spark):
    assert sum(r["n"] for r in QUERIES["terminal_split"](spark, SF).collect()) == rows_of(spark, "events").count()


def name(i):
    return "Name" + "".join(chr(97 + int(c)) for c in f"{i:03d}")


@pytest.fixture
def long_text(spark, tmp_path):
    """A document with a word of its own in every chunk, long after its first words, and one with a single word."""
    text = " ".join(name(i) + " filler" * 20 for i in range(200))
    spark.createDataFrame([(1, text, "s"), (2, "only Single here", "s")], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_graph_covers_whole_texts(spark, long_text):
    nodes = {r["canonical"] for r in QUERIES["graph_nodes"](spark, long_text).collect()}
    every = {name(i).lower() for i in range(200)} | {"single"}
    assert every <= nodes  # a window can begin or end inside a word
    assert QUERIES["graph_type_counts"](spark, long_text).agg({"n": "sum"}).first()[0] == len(nodes)
    assert QUERIES["graph_edges"](spark, long_text).count() > 150
    assert QUERIES["evidence_detail"](spark, long_text).filter("canonical = 'namebjj'").count() > 0


def test_messages_count_whole(spark, tmp_path):
    end = "we have looked at the first half of this; how about Kubernetes"
    rows = [(1, 0, "user", "hello there"), (1, 1, "user", "so far " * 12 + end), (1, 2, "user", "well then")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "u", "<p>" + "x" * 50 + "end</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    topics = {r["seq"]: r["topic_seq"] for r in QUERIES["latest_topic"](spark, str(tmp_path)).collect()}
    assert topics[3] == 2
    scores = {r["seq"]: r["score"] for r in QUERIES["followup_score"](spark, str(tmp_path)).collect()}
    assert scores[2] == 2  # the refinement stands at the end
    asked = {r["seq"]: r["query"] for r in QUERIES["fallback_queries"](spark, str(tmp_path)).collect()}
    assert asked[2].endswith(end)
    page = QUERIES["web_results"](spark, str(tmp_path)).first()
    assert page["title"].endswith("end</p>") and "end</p>" in page["content"]


def test_mind_maps_of_every_document(spark, tmp_path):
    rows = [(i, f"Common words, then Rare{chr(97 + i % 26)}{chr(97 + i // 26)} words.", "s") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    top = QUERIES["mindmap_topk"](spark, str(tmp_path))
    assert {r["doc_id"] for r in top.collect()} == set(range(120)) and top.count() == 240
    maps = {r["doc_id"]: r["markdown"] for r in QUERIES["mindmap_markdown"](spark, str(tmp_path)).collect()}
    assert set(maps) == set(range(120)) and "#### Rarepe [ENTITY] x1" in maps[119]


def test_searches_take_whole_queries(spark):
    due = rows_of(spark, "embeddings").filter("vec_id % 20 = 0").count()
    assert QUERIES["vector_topk"](spark, SF).select("query_id").distinct().count() == due
    items = rows_of(spark, "benchmark").filter("item_id % 20 = 0 AND trim(text) <> ''").count()
    assert QUERIES["bm25_topk"](spark, SF).select("query_id").distinct().count() == items


def test_phrases_ask_for_order(spark):
    texts = ["alpha gamma", "gamma alpha", "alpha " + "beta " * 300 + "gamma", "alpha beta gamma", "alpha", "so so it goes"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    posts = index.postings(rows, {"content": "text"}, positions=True)
    found = lambda q: {r["chunk_id"] for r in search.search_clauses(posts, q).collect()}
    assert found('"alpha gamma"') == {0}
    assert found('"alpha gamma"~1') == {0, 3}
    assert found('"alpha gamma"~2') == {0, 1, 3}
    assert found('"alpha gamma"~300') == {0, 1, 2, 3}
    assert found('"so so"') == {5} and found('"alpha alpha"~3') == set()
    assert found('alpha -"alpha gamma"') == {1, 2, 3, 4}
