"""Search, graph, chat, health, sinks, files and streams on small cases."""

import hashlib
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import chat, graph, health, index, peripheral, search
from corpuslens.operators import relational as R
from corpuslens.sources import files, sinks
from corpuslens.streaming import ingest, rate, runs


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(1, "alpha beta gamma", "one.md"), (2, "beta beta delta", "two.md"), (3, "类 Service code", "three.md")]
    return index.postings(spark.createDataFrame(rows, "chunk_id int, text string, name string"), {"content": "text", "fileName": "name"})


def keys(df):
    return {r.chunk_id for r in df.collect()}


def test_refinements_end_at_word_boundaries(spark):
    want = {"for of. Th": False, "about C++ now": False, "about C++x now": True, "and then?": True, "details": True, "in Rust": True, "in Ru": False, "alsoo": False}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.m for r in rows.select("t", F.col("t").rlike(chat.ENGLISH_REFINEMENT).alias("m")).collect()} == want


def test_query_syntax():
    parsed = search.parse_query('+alpha -fileName:two "beta gamma"^2 del* f~ a?b')
    assert [(c.text, c.field, c.occur, c.kind, c.boost) for c in parsed] == [
        ("alpha", None, "must", "term", 1.0), ("two", "fileName", "must_not", "term", 1.0), ("beta gamma", None, "should", "phrase", 2.0),
        ("del", None, "should", "prefix", 1.0), ("f", None, "should", "fuzzy", 1.0), ("a?b", None, "should", "wildcard", 1.0)]
    assert [c.occur for c in search.parse_query("a AND b NOT c")] == ["must", "must", "must_not"]
    for bad in ("(a", "a AND", "AND a", 'x"y'):
        with pytest.raises(search.QuerySyntaxError):
            search.parse_query(bad)
    assert [c.text for c in search.query_clauses("foo(bar")] == ["foo", "bar"]


def test_search_clauses(posts):
    assert keys(search.search_clauses(posts, "beta")) == {1, 2}
    assert keys(search.search_clauses(posts, "beta -delta")) == {1}
    assert keys(search.search_clauses(posts, "+beta +delta")) == {2}
    assert keys(search.search_clauses(posts, '"alpha gamma"')) == {1}
    assert keys(search.search_clauses(posts, "fileName:two")) == {2}
    assert keys(search.search_clauses(posts, "del*")) == {2}
    assert keys(search.search_clauses(posts, "gamm~")) == {1}
    assert keys(search.search_clauses(posts, "类 service")) == {3}
    assert keys(search.search_clauses(posts, "(broken beta")) == {1, 2}


def test_replace_and_delete_documents(spark, posts):
    new = index.postings(spark.createDataFrame([(2, "fresh")], "chunk_id int, text string"), {"content": "text"})
    after = index.replace_documents(posts, new, "chunk_id")
    assert keys(search.search_clauses(after, "fresh")) == {2} and keys(search.search_clauses(after, "delta")) == set()
    assert keys(index.delete_documents(posts, new, "chunk_id")) == {1, 3}


def test_vector_and_hybrid(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [0.9, 0.1, 0.0, 0.0])], "query_id int, embedding array<float>")
    vec = search.vector_topk(vectors, q, 2, "vec_id")
    assert [r.vec_id for r in vec.orderBy("rank").collect()] == [1, 2]
    kw = spark.createDataFrame([(0, 3, 5.0, 1), (0, 2, 4.0, 2)], "query_id int, vec_id int, score double, rank int")
    fused = search.fuse(kw, vec, 8, "vec_id").orderBy("rank").collect()
    assert [r.vec_id for r in fused] == [2, 1, 3]
    assert fused[0].score == pytest.approx(0.45 / 62 + 0.55 / 62)
    assert search.clamp_k(None) == 8 and search.clamp_k(99) == 50 and search.clamp_k(0) == 1 and search.candidates(8) == 64


def test_embedding_batches_keep_order_and_check_sizes(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "i int, t string")
    out = peripheral.embed(df, "t", lambda texts: [[float(len(t)), 1.0] for t in texts], 2, batch=16)
    assert all(r.embedding == [float(r.i), 1.0] for r in out.collect())
    with pytest.raises(Exception, match="embedder"):
        peripheral.embed(df, "t", lambda texts: [[1.0]] * len(texts), 2).collect()


def test_history_window_keeps_the_newest(spark):
    long = spark.createDataFrame([(1, i, "USER", "word " * 2000) for i in range(1, 13)], "conv_id int, seq int, role string, text string")
    assert sorted(r.seq for r in chat.history_window(long, chat.history_budget(1024)).collect()) == list(range(5, 13))
    short = spark.createDataFrame([(1, i, "USER", "hi") for i in range(1, 42)], "conv_id int, seq int, role string, text string")
    assert chat.history_window(short, chat.history_budget(128_000)).count() == 41
    assert not chat.context_usage(short, 128_000).first().summarise and chat.context_usage(long, 1024).first().summarise


def test_follow_up_examples(spark):
    invoke = ["那它呢？", "有没有代码示例", "继续展开", "what about that", "实现代码案例"]
    skip = ["Spring是什么", "Redis 怎么配置持久化"]
    rows = [(i, 1, "USER", "Kafka 是什么") for i in range(7)] + [(i, 2, "USER", q) for i, q in enumerate(invoke + skip)]
    got = chat.follow_ups(spark.createDataFrame(rows, "conv_id int, seq int, role string, text string")).filter("seq = 2").orderBy("conv_id").collect()
    assert [r.invoke for r in got] == [True] * 5 + [False] * 2
    first = chat.follow_ups(spark.createDataFrame(rows, "conv_id int, seq int, role string, text string")).filter("seq = 1").first()
    assert first.reason == "auto_no_history" and not first.invoke


def test_reference_limits(spark):
    refs = [(i, "x" * 1300) for i in range(7)] + [(0, "x" * 1300)]
    df = spark.createDataFrame([(refs,)], "r array<struct<message_id: int, snippet: string>>")
    got = df.select(chat.limit_references(F.col("r")).alias("r")).first().r
    assert [len(x.snippet) for x in got] == [1200, 1200, 1200, 400]


def payload(nodes, edges):
    return "note " + json.dumps({"nodes": nodes, "edges": edges}) + " end"


def test_graph_merge(spark):
    node = lambda n, q, t="tool": {"name": n, "type": t, "description": "", "confidence": 0.5, "quote": q}
    edge = lambda s, t, q: {"source": s, "target": t, "type": "depends on", "displayLabel": "依赖", "description": "", "confidence": 2.0, "quote": q}
    rows = [
        ("c1", "d1", "Alpha uses Beta.", payload([node("Alpha", "alpha"), node("Beta", "not there"), node("Ghost", "ghost")], [edge("alpha", "BETA", "uses beta"), edge("alpha", "alpha", "alpha"), edge("alpha", "nobody", "alpha")])),
        ("c2", "d1", "ALPHA again", payload([node(" alpha ", "alpha again")], [])),
        ("c3", "d2", "broken", "no json"),
    ]
    parsed = graph.parse_extractions(spark.createDataFrame(rows, "chunk_id string, document_id string, content string, extraction_json string"))
    nodes, edges, evidence = graph.merge(parsed)
    got = {r.canonical: (r.mention_count, r.node_type, r.display_name) for r in nodes.collect()}
    assert got == {"alpha": (3, "TOOL", "Alpha"), "beta": (1, "TOOL", "Beta")}
    e = edges.collect()
    assert [(r.a_name, r.b_name, r.type, r.label, r.mention_count, r.confidence) for r in e] == [("alpha", "beta", "CONSTRAINT", "依赖", 1, 1.0)]
    assert evidence.count() == 4


def test_graph_views(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}", i) for i in range(1, 102)], "node string, mentions int")
    edges = spark.createDataFrame([("n001", "n101"), ("n100", "n101")], "source string, target string")
    top = graph.top_nodes(nodes, edges)
    rows = top.collect()
    assert len(rows) == 100 and rows[0].node == "n101" and rows[0].degree == 2
    assert [tuple(r) for r in graph.induced(edges, top).collect()] == [("n100", "n101")]
    flags = graph.view_flags(spark.createDataFrame([("ALL", None, "MINDMAP"), ("ALL", None, "GRAPH")], "scope_type string, scope_id string, view_type string")).collect()
    assert len(flags) == 1 and flags[0].has_graph and flags[0].has_mindmap


def test_scope_delete(spark):
    t = {n: spark.createDataFrame([(f"{n}1", "ALL", None), (f"{n}2", "DOCUMENT", "d")], "id string, scope_type string, scope_id string") for n in ("nodes", "edges", "runs", "views")}
    t["evidence"] = spark.createDataFrame([("e1", "runs1", "nodes1", None), ("e2", "runs2", None, "edges2")], "id string, run_id string, node_id string, edge_id string")
    left = graph.delete_scope(t, "ALL", None)
    assert [r.id for r in left["evidence"].collect()] == ["e2"] and [r.id for r in left["nodes"].collect()] == ["nodes2"]


def test_disabled_folder_is_no_issue(spark):
    s = spark.createDataFrame([("a", False, 0, 0, 0, 0, 3, 0), ("b", True, 0, 0, 0, 0, 0, 0), ("c", True, 5, 1, 2, 0, 0, 0), ("d", True, 5, 0, 0, 0, 0, 0)], "folder string, enabled boolean, documents int, failed int, unindexed int, missing int, stale int, new_files int")
    issues = health.folder_issues(s)
    assert {r.folder: r.health for r in health.folder_status(s, issues).collect()} == {"a": "DISABLED", "b": "WARNING", "c": "ERROR", "d": "HEALTHY"}
    assert [r.code for r in issues.filter("folder = 'c'").orderBy("pos").collect()] == ["PARSE_FAILED", "UNINDEXED_DOCUMENTS"]


def test_lookup_order_and_cap(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = R.ordered_lookup(rows, list(range(999, 300, -1)), "k").orderBy("pos").collect()
    assert [r.k for r in got] == list(range(999, 499, -1))
    assert R.ordered_lookup(rows, [], "k").count() == 0


def test_frames(spark):
    lines = ["event: delta", "data:  hi", "data: there", "", "", "data: {}", "event: done", "", "event: lost"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "stream_id int, n int, line string")
    got = [(r.event, r.data) for r in peripheral.frames(df).orderBy("frame").collect()]
    assert got == [("delta", " hi\nthere"), ("done", "{}")]
    assert peripheral.unfinished(peripheral.frames(df)).count() == 0


def test_outline(spark):
    text = "# All\n## Doc\n### Head\n#### Tool [APP] x3\n### Next\n#### Lone\nnone"
    got = peripheral.outline(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("line").collect()
    assert [(r.label, r.type, r.mentions, r.parent) for r in got] == [("All", "SCOPE", 0, None), ("Doc", "DOCUMENT", 0, 0), ("Head", "HEADING", 0, 1), ("Tool", "APP", 3, 2), ("Next", "HEADING", 0, 1), ("Lone", "ENTITY", 0, 4)]


def test_files_and_ingest(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("intro\n# Head\nbody", encoding="utf-8")
    (folder / "b.TXT").write_bytes("caf\xe9".encode("latin-1"))
    (folder / "empty.txt").write_text(" ")
    (folder / "skip.exe").write_text("x")
    (folder / "sub" / "p.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    scanned = files.scan(spark, str(folder))
    got = {r.file_name: r for r in files.parse(scanned).collect()}
    assert got["a.md"].sections[0].heading == "Head" and got["a.md"].error is None
    assert got["d.docx"].sections[0].content == "Para\ntwo"
    assert got["empty.txt"].error == "no text" and got["p.pdf"].error and "skip.exe" not in got
    records = ingest.ingest_batch(scanned, spark.createDataFrame([], ingest.RECORD), keep_failed=False)
    rows = spark.createDataFrame(records.collect(), ingest.RECORD)
    assert {r.file_name: r.status for r in rows.collect()}["a.md"] == "PARSED"
    again = health.classify_changes(scanned.select(F.col("document_id").alias("id"), "size", "modified", "hash"), rows)
    assert {r.change for r in again.join(rows.filter("status = 'PARSED'"), "id").collect()} == {"reindex"}
    (folder / "a.md").unlink()
    assert "a.md" not in {r.file_name for r in ingest.remove_missing(rows, files.scan(spark, str(folder))).collect()}


def make_pdf(pages, compress=True):
    """A small PDF: each page is a list of lines."""
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, lines in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
        packed = zlib.compress(body) if compress else body
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(packed), b" /Filter /FlateDecode" if compress else b"") + packed + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_pages(compress):
    from corpuslens.sources.pdf import PdfError, pdf_pages

    got = pdf_pages(make_pdf([["First (page)", "caf\xe9"], [], ["Third"]], compress))
    assert [(s["page_number"], s["content"]) for s in got] == [(1, "First (page)\ncaf\xe9"), (3, "Third")]
    assert pdf_pages(make_pdf([[], []])) == []
    for bad in (b"%PDF-1.4 1 0 obj << /Encrypt 3 0 R >> endobj", b"hello"):
        with pytest.raises(PdfError):
            pdf_pages(bad)


def test_pdf_strings_with_unicode_maps():
    from corpuslens.sources.pdf import _cmap, _page_text

    cmap = _cmap(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0010> <0012> <4E00> endbfrange")
    assert _page_text(b"BT /F1 1 Tf [<00010010> -300 <0012>] TJ T* <0011> ' ET", {b"/F1": cmap}) == "A\u4e00 \u4e02\n\u4e01"


def test_streaming_ingest_goes_on_where_it_stopped(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "records"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    ingest.start(spark, str(folder), table, check).awaitTermination(120)
    (folder / "b.txt").write_text("two")
    ingest.start(spark, str(folder), table, check).awaitTermination(120)
    assert {r.file_name: r.status for r in ingest.known(spark, table).collect()} == {"a.txt": "PARSED", "b.txt": "PARSED"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("v", F.lit("a"))
    sinks.overwrite(df, path)
    sinks.overwrite(spark.read.parquet(path).filter("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.read_or_empty(spark, str(tmp_path / "no"), "id long").count() == 0
    parts = str(tmp_path / "p")
    sinks.replace_buckets(df, parts, "id", 4)
    sinks.replace_buckets(df.filter("id = 1").withColumn("v", F.lit("b")), parts, "id", 4)
    assert spark.read.parquet(parts).filter("v = 'b'").count() == 1
    texts = spark.createDataFrame([("",), (None,), ("[{bad",), ('[{"chunk_id": "c", "score": 1}]',)], "x string")
    assert sorted(len(r.s) for r in texts.select(sinks.decode_sources(F.col("x")).alias("s")).collect()) == [0, 0, 0, 1]


def test_run_control(spark):
    schema = "run_id int, scope_type string, scope_id string, operation string, status string, created_at long, queued_at long, started_at long, completed_at long"
    rows = spark.createDataFrame([(1, "ALL", None, "SYNC", "QUEUED", 1, 1, None, None), (2, "ALL", None, "IMPORT", "RUNNING", 1, 1, 2, None), (3, "ALL", None, "SYNC", "COMPLETED", 1, 1, 2, 3)], schema)
    moved = runs.transition(rows, spark.createDataFrame([(1, "CANCELLED"), (3, "RUNNING"), (2, "COMPLETED")], "run_id int, to string"), F.lit(9).cast("long"))
    assert {r.run_id: (r.status, r.completed_at) for r in moved.collect()} == {1: ("CANCELLED", 9), 2: ("COMPLETED", 9), 3: ("COMPLETED", 3)}
    assert {r.run_id: r.status for r in runs.repair(rows, F.lit(9).cast("long")).collect()} == {1: "CANCELLED", 2: "FAILED", 3: "COMPLETED"}
    asked = spark.createDataFrame([(4, "ALL", None, "SYNC", "QUEUED", 5, 5, None, None), (5, "ALL", None, "DELETE", "QUEUED", 5, 5, None, None), (6, "ALL", None, "DELETE", "QUEUED", 5, 6, None, None)], schema)
    assert [r.run_id for r in runs.enqueue(rows, asked).collect()] == [5]
    assert runs.dispatch(rows).count() == 0 and runs.dispatch(rows.filter("run_id <> 2")).first().run_id == 1


def test_rate_limiter_and_retries():
    now = [0.0]
    limiter = rate.RateLimiter(requests=60, tokens=100, width=60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert limiter.acquire(60) == 0 and limiter.acquire(30) == pytest.approx(1.0)
    assert limiter.acquire(30) == pytest.approx(59.0)
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429")
        return "ok"

    assert rate.with_retries(call, lambda e: "429" in str(e), sleep=pauses.append, jitter=lambda: 0) == "ok" and pauses == [1.0, 2.0]
    with pytest.raises(ValueError):
        rate.with_retries(lambda: (_ for _ in ()).throw(ValueError()), lambda e: False)


def test_event_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    q = ingest.event_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == spark.read.parquet(str(tmp_path / "e")).count()


def test_blank_helpers(spark):
    assert spark.range(1).select(T.is_blank(F.lit(" \n")).alias("x")).first().x


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(1)
    x[50] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.filter("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expect = {(q, int(v), r + 1) for q in range(0, 300, 7) for r, v in enumerate(sorted(range(300), key=lambda v: (-round((1 + unit[q] @ unit[v]) / 2, 9), v))[:5])}
    for block in (2048, 10):
        monkeypatch.setattr(search, "BLOCK", block)
        assert {(r.query_id, r.vec_id, r.rank) for r in search.vector_topk(vectors, asked, 5).collect()} == expect
    assert search.vector_topk(vectors, asked.limit(0), 5).count() == 0 and search.vector_topk(vectors.limit(0), asked, 5).count() == 0


def test_swap_that_was_cut_short(spark, tmp_path):
    """Whatever step of a swap is the last one, the table is there afterwards, old or new."""
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(3), path)
    read = lambda: sorted(r.id for r in sinks.read_or_empty(spark, path, "id long").collect())
    spark.range(9).write.parquet(f"{path}.new-a")  # the new one is written, nothing is moved
    assert read() == [0, 1, 2]
    (tmp_path / "t").rename(tmp_path / "t.old-a")  # the old one is moved away
    assert read() == list(range(9))
    (tmp_path / "t").rename(tmp_path / "t.old-b")
    (tmp_path / "t.new-half").mkdir()  # a new one that isn't complete doesn't count
    (tmp_path / "t.old-a" / "_SUCCESS").unlink()
    assert read() == list(range(9))
    sinks.overwrite(spark.read.parquet(path).filter("id < 2"), path)
    assert read() == [0, 1] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_crash_between_batches_loses_no_record(spark, tmp_path, monkeypatch):
    folder, table, check = tmp_path / "in", str(tmp_path / "records"), str(tmp_path / "check")
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.md").write_text(f"# title {i}\ntext {i}")
    ingest.start(spark, str(folder), table, check).awaitTermination(120)
    (folder / "f9.md").write_text("new")
    (folder / "f0.md").unlink()
    put, calls = ingest._put, []

    def broken(*args):
        calls.append(args)
        if len(calls) == 2:  # the stream's batch, after the changes of the folder
            raise OSError("stopped")
        put(*args)

    monkeypatch.setattr(ingest, "_put", broken)
    q = ingest.start(spark, str(folder), table, check)
    try:
        q.awaitTermination(120)
    except Exception:  # noqa: BLE001  the stream fails as it should
        pass
    monkeypatch.setattr(ingest, "_put", put)
    ingest.start(spark, str(folder), table, check).awaitTermination(120)
    want = {"f1.md": "PARSED", "f2.md": "PARSED", "f9.md": "PARSED"}
    assert len(calls) == 2 and {r.file_name: r.status for r in ingest.known(spark, table).collect()} == want
    # a bucket that was taken away but not put back yet
    shutil.rmtree(next(p for p in (tmp_path / "records").iterdir() if p.name.startswith("bucket=")))
    ingest.sync(spark, str(folder), table)
    assert {r.file_name: r.status for r in ingest.known(spark, table).collect()} == want


def test_sync_sees_new_changed_and_removed_files(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "records")
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.md").write_text(f"text {i}")

    def state():
        return {r.file_name: (r.size, r.hash) for r in ingest.known(spark, table).collect()}

    def parts():
        return {p.parent.name: p.name for p in (tmp_path / "records").rglob("part-*.parquet")}

    assert {r.change for r in ingest.sync(spark, str(folder), table).collect()} == {"new"}
    first, files_before = state(), parts()
    (folder / "f1.md").write_text("text 1, edited")
    (folder / "f2.md").rename(folder / "moved.md")
    (folder / "f3.md").unlink()
    (folder / "sub").mkdir()
    (folder / "sub" / "f7.md").write_text("deeper")
    got = {(r.path.split("/")[-1], r.change) for r in ingest.sync(spark, str(folder), table).collect()}
    assert got == {("f1.md", "changed"), ("f2.md", "gone"), ("moved.md", "new"), ("f3.md", "gone"), ("f7.md", "new")}
    now = state()
    assert set(now) == {"f0.md", "f1.md", "f4.md", "f5.md", "moved.md", "f7.md"}
    assert now["f1.md"] == (14, hashlib.sha256(b"text 1, edited").hexdigest()) and all(now[f] == first[f] for f in ("f0.md", "f4.md", "f5.md"))
    after = parts()
    assert sum(after.get(k) == v for k, v in files_before.items()) >= 1  # buckets without changes are as they were
    assert ingest.sync(spark, str(folder), table).count() == 0 and parts() == after
    # a batch run over the same folder gives the same records
    fresh = str(tmp_path / "fresh")
    ingest.sync(spark, str(folder), fresh)
    assert {r.file_name: (r.size, r.hash) for r in ingest.known(spark, fresh).collect()} == now
    # the file comes back, and an edit is seen by the stream's start as well
    (folder / "f3.md").write_text("again")
    (folder / "f4.md").write_text("text 4, edited too")
    ingest.start(spark, str(folder), table, str(tmp_path / "check")).awaitTermination(120)
    assert state()["f3.md"][0] == 5 and state()["f4.md"][0] == 18


def test_readiness(spark):
    folder = {"enabled": True, "documents": 3, "parsed": 3, "failed": 0, "unindexed": 0, "missing": 0, "stale": 0, "new_files": 0}
    good, none = spark.createDataFrame([(True,)], "consistent boolean"), spark.createDataFrame([], "copies long")

    def ready(consistent=True, **changes):
        s = spark.createDataFrame([folder | changes])
        return health.answer_readiness(s, good.select((F.col("consistent") == consistent).alias("consistent")), none, none, embedding=True).first()

    assert ready().ready and ready().searchable == 3
    for changes in ({"documents": 0, "parsed": 0}, {"failed": 1}, {"unindexed": 1}, {"missing": 1}, {"stale": 2}, {"new_files": 1}, {"enabled": False}):
        assert not ready(**changes).ready
    bad = ready(consistent=False, failed=2)
    assert not bad.ready and bad.retrieval == 3


def test_summary_covers_what_it_cuts(spark):
    rows = [(1, i, "USER" if i % 2 else "ASSISTANT", "x" * 200 if i != 3 else " ") for i in range(1, 61)]
    got = chat.rolling_summary(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")).first()
    lines = got.summary.split("\n")
    assert got.up_to == 52 and lines[0] == chat.SUMMARY_HEAD.strip() and lines[-1] == chat.SUMMARY_TAIL.strip()
    assert lines[3] == "- [UNKNOWN] 用户：" and 10 < len(lines) < 25 and len(got.summary) <= 4000 + len(chat.SUMMARY_TAIL)


def test_mind_map_filter(spark):
    nodes = spark.createDataFrame([("s", "All", "scope", ""), ("d", "Doc", "document", ""), ("h", "Head", "heading", ""), ("e", "Bus", "entity", "T"), ("f", "Car", "entity", "U"), ("g", "Other", "heading", "")], "id string, label string, kind string, type string")
    edges = spark.createDataFrame([("s", "d"), ("d", "h"), ("d", "g"), ("h", "e"), ("h", "f")], "source string, target string")
    ids = lambda *a: {r.id for r in graph.mind_map_filter(nodes, edges, *a)[0].collect()}
    assert ids("bus") == {"s", "d", "h", "e"} and ids("doc") == {"s", "d", "h", "g"} and ids("nothing") == set()
    assert ids() == set("sdhefg") and ids(None, ["T"]) == set("sdhefg")  # children of headings stay
    only = nodes.filter("kind = 'entity'")
    assert {r.id for r in graph.mind_map_filter(only, edges.limit(0), None, ["X"])[0].collect()} == {"e", "f"}
    assert {tuple(r) for r in graph.mind_map_filter(nodes, edges, "bus")[1].collect()} == {("s", "d"), ("d", "h"), ("h", "e")}


def test_search_tool():
    from corpuslens.operators.peripheral import SearchTool

    def search_web(q):
        if q == "bad":
            raise ValueError("down")
        return [{"title": q}]

    tool = SearchTool(search_web, 3)
    assert tool(" a  b ")["results"] == [{"title": "a b"}] and not tool(" ")["success"]
    assert tool("bad") == {"success": False, "message": "down", "results": []}
    assert tool("c")["success"] and not tool("d")["success"] and len(tool.records) == 5


def test_code_fields(spark):
    text = "Before\n```java\nclass OrderService { load(user_id) }\n```\nAfter\n``` mermaid\nsequenceDiagram\nA->>B: x"
    rows = spark.createDataFrame([(1, "a.md", "Head", text), (2, "b.md", None, None), (3, "c.md", " ", "```x```\nplain")], "chunk_id int, file_name string, heading string, content string")
    got = {r.chunk_id: r for r in index.chunk_texts(rows).collect()}
    assert got[1].prose == "a.md\nHead\nBefore\nAfter\n" and got[2].prose == "b.md" and got[2].code == ""
    code = got[1].code.split("\n")
    assert {"java", "mermaid", "OrderService", "Order", "Service", "user_id", "user", "id", "sequencediagram"} <= set(code)
    assert "After" not in got[1].code and "OrderService" not in got[1].prose and "```x```" in got[3].prose


def test_evidence_in_other_forms(spark):
    from corpuslens.functions import canonical as C

    rows = spark.createDataFrame([("系统使用ＡＰＩ网关", "API网关"), ("plain text here", "TEXT, here"), ("ﬁle", "file"), ("none", ""), (None, "x"), ("abc", None)], "c string, q string")
    assert [r.f for r in rows.select(C.quote_found(F.col("c"), F.col("q")).alias("f")).collect()] == [True, True, True, False, False, False]


def test_pending_cancellations(spark):
    asked = spark.createDataFrame([("a", 100_000), ("b", 100_000), ("c", 100_000), ("d", 5)], "request_id string, started_at long")
    cancels = spark.createDataFrame([("a", 70_000), ("b", 69_999), ("c", 200_000)], "request_id string, at long")
    assert {r.request_id: r.cancelled for r in runs.cancelled_requests(asked, cancels).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_queue_of_many_ranges(spark):
    from corpuslens.operators import relational

    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id * 7919 % 997 END AS queued_at")
    got = relational.queue_positions(rows, "queued_at", "id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 5001))
    keys = [(-1 if r.queued_at is None else r.queued_at, r.id) for r in got]
    assert keys == sorted(keys)
