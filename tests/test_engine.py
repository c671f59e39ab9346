"""Search modes, fallbacks and gates through the engine; progress events."""

import pytest

from corpuslens.operators import chat, graph, index
from corpuslens.operators.engine import EmbeddingUnavailable, Engine
from corpuslens.streaming.progress import RunProgress, StreamProgress


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(1, "the apollo manual", "f1", True), (2, "the borealis manual", "f1", True), (3, "apollo in a folder that is off", "f2", False)], "doc_id int, text string, folder string, enabled boolean")
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0])], "doc_id int, embedding array<float>")
    return index.postings(docs, {"content": "text"}, "doc_id"), docs, vectors


def embed(texts):
    return [[1.0, 0, 0, 0] if "apollo" in t else [0, 1.0, 0, 0] if "borealis" in t else [0, 0, 1.0, 0] for t in texts]


def test_modes(tables):
    e = Engine(*tables, embed)
    for mode in ("KEYWORD", "VECTOR", "HYBRID", None):
        first = e.search("apollo", mode).first()
        assert first.doc_id == 1 and "apollo" in first.preview
    assert [r.doc_id for r in e.search("apollo", "KEYWORD").collect()] == [1]
    assert e.search("  ").count() == 0 and e.search("apollo", k=0).count() == 1
    with pytest.raises(ValueError):
        e.search("x", "OTHER")


def test_enable_brings_hits_back(tables):
    posts, docs, vectors = tables
    from pyspark.sql import functions as F

    on = Engine(posts, docs.withColumn("enabled", F.lit(True)), vectors, embed)
    assert {r.doc_id for r in on.search("apollo", "KEYWORD").collect()} == {1, 3}


def test_without_embedder(tables):
    e = Engine(tables[0], tables[1])
    for mode in ("VECTOR", "HYBRID"):
        with pytest.raises(EmbeddingUnavailable):
            e.search("apollo", mode)
    hits, mode, used = e.retrieve("apollo")
    assert mode == "KEYWORD" and hits.count() == 1 and used == "apollo"
    hits, _, used = e.retrieve("nothing here", rewrite=lambda q: "borealis")
    assert used == "borealis" and hits.first().doc_id == 2
    assert e.retrieve("nothing here", rewrite=lambda q: None)[0].count() == 0


def test_scope_of_a_folder_that_is_off(tables):
    with pytest.raises(ValueError):
        graph.scope_documents(tables[1], "KNOWLEDGE_FOLDER", "f2")
    assert graph.scope_documents(tables[1], "ALL").count() == 2 and graph.scope_documents(tables[1], "DOCUMENT", 1).count() == 1


def test_answers_of_streams(spark):
    rows = [(1, 0, "meta", ""), (1, 1, "delta", "Hel"), (1, 2, "delta", "lo"), (1, 3, "done", ""), (1, 4, "delta", "late"), (2, 0, "delta", "part"), (3, 0, "delta", " "), (3, 1, "error", ""), (4, 0, "delta", "x"), (4, 1, "error", "")]
    got = {r.stream_id: (r.text, r.status) for r in chat.stored_answers(spark.createDataFrame(rows, "stream_id int, n int, event string, data string")).collect()}
    assert got == {1: ("Hello", "DONE"), 2: ("part", "STOPPED"), 4: ("x", "ERROR")}


def test_progress_is_flushed_every_ten_or_five_seconds():
    sent, now = [], [0.0]
    p = RunProgress(lambda kind, data: sent.append((kind, data.get("current"))), 25, clock=lambda: now[0])
    p.start()
    for i in range(25):
        now[0] += 6 if i == 3 else 0
        p.step()
    p.finish()
    assert sent == [("started", 0), ("progress", 4), ("progress", 14), ("progress", 24), ("progress", 25), ("completed", 25)]


def test_stream_listener(spark, tmp_path):
    sent = []
    listener = StreamProgress(lambda kind, data: sent.append(kind))
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "r"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "r")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        import time

        for _ in range(50):
            if sent and sent[-1] == "completed":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sent[0] == "started" and "progress" in sent and sent[-1] == "completed"
