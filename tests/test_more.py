"""Graph deltas, open headings, strings deep in JSON, run deletions, scores without postings: small cases and brute force."""

import json
import random

from pyspark.sql import functions as F

from corpuslens.operators import graph, index, peripheral, search
from corpuslens.streaming import runs


def extraction(i, rng, content=None):
    names = rng.sample(["Alpha", "Beta", "Gamma", "Ｄelta", "Epsilon"], 3)
    content = content or f"{names[0]} knows {names[1]}, not {names[2]}."
    nodes = [{"name": n, "type": "thing", "description": rng.choice(["", f"about {n} {i}"]), "confidence": rng.choice([0.2, 0.9]), "quote": rng.choice([n, "missing quote"])} for n in names]
    edges = [{"source": names[0], "target": names[1], "type": "uses", "displayLabel": "使用", "description": "", "confidence": 0.5, "quote": rng.choice(["knows", "nowhere"])}]
    return (f"c{i}", i, content, json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False))


SCHEMA = "chunk_id string, document_id long, content string, extraction_json string"


def rows(df, drop=()):
    names = [c for c in sorted(df.columns) if c not in drop]
    return sorted(repr(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names)) for r in df.collect())


def test_deltas_equal_a_merge(spark):
    rng = random.Random(4)
    old = {i: extraction(i, rng) for i in range(40)}
    new = {i: r for i, r in old.items() if i % 9 != 0} | {i: extraction(i, rng) for i in [*range(5, 12), *range(40, 47)]}
    changed = [i for i in {*old, *new} if old.get(i) != new.get(i)]
    frame = lambda some: graph.parse_extractions(spark.createDataFrame(some, SCHEMA))
    before, after = graph.evidence(frame(list(old.values()))), graph.evidence(frame([new[i] for i in changed if i in new]))
    ids = spark.createDataFrame([(i,) for i in changed], "document_id long")
    nodes, edges, _ = graph.merge(frame(list(new.values())))
    for k, partials_of, rows_of, key, want in ((0, graph.node_partials, graph.nodes_of, graph.NODE_KEY, nodes), (1, graph.edge_partials, graph.edges_of, graph.EDGE_KEY, edges)):
        partials = partials_of(before[k])
        now, got = graph.apply_delta(partials, rows_of(partials), partials_of(after[k]), ids, key, rows_of)
        assert rows(got) == rows(want.select(*got.columns))
        assert rows(rows_of(now)) == rows(got)


def test_quotes_are_looked_for_in_their_own_chunk(spark):
    payload = {"nodes": [{"name": "A", "quote": "x\u0001y"}, {"name": "B", "quote": None}, {"name": "C", "quote": "Ｃ c"}], "edges": []}
    parsed = graph.parse_extractions(spark.createDataFrame([("1", 1, "x y, cC", json.dumps(payload)), ("2", 1, None, '{"nodes": [], "edges": []}'), ("3", 1, "z", "no json")], SCHEMA))
    assert sorted(r.canonical for r in graph.merge(parsed)[0].collect()) == ["a", "c"]


def test_open_headings(spark):
    text = "before\n# One\na Alpha\n### Deep\nb\n## Two \nc Alpha Beta\n# Next\nd\n####### no heading\n#none\n## Two\ne Beta"
    lines = graph.headed_lines(spark.createDataFrame([(1, text), (2, None), (3, "only text")], "doc_id long, text string"))
    got = {(r.doc_id, r.line): (r.heading, r.path) for r in lines.collect()}
    assert got[1, "before"] == (graph.NO_HEADING, []) and got[1, "a Alpha"] == ("One", ["One"]) and got[1, "b"] == ("Deep", ["One", "Deep"])
    assert got[1, "c Alpha Beta"] == ("Two", ["One", "Two"]) and got[1, "d"] == got[1, "#none"] == got[1, "####### no heading"] == ("Next", ["Next"])
    assert got[1, "e Beta"] == ("Two", ["Next", "Two"]) and got[2, ""][0] == got[3, "only text"][0] == graph.NO_HEADING
    top = {(r.heading, r.place, r.node, r.n, r["rank"]) for r in graph.entities_by_heading(lines, "[A-Z][a-z]{3,}").collect()}
    assert top == {("One", 2, "Alpha", 1, 1), ("Two", 4, "Alpha", 1, 2), ("Two", 4, "Beta", 2, 1)}


def test_strings_deep_in_json(spark):
    cases = [
        ('{"capabilities": {"a": [["Embedding\\"s"], {"x": "chat"}], "n": 1, "embed": true}}', ['Embedding\\"s', "chat"]),
        ('{"capabilities": "plain"}', ["plain"]), ('{"capabilities": {"chat": {"deep": {"deeper": [1, null, ["v: w"]]}}}}', ["v: w"]), ('{"other": "chat"}', []), ('{"capabilities": null}', []), ("no json", []), (None, []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    got = {r.i: r.s for r in df.select("i", peripheral.string_values(F.col("j"), "capabilities").alias("s")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_deleted_runs(spark):
    have = spark.createDataFrame([(1, "COMPLETED"), (2, "RUNNING"), (3, "FAILED")], "run_id long, status string")
    left, outcomes = runs.delete_runs(have, spark.createDataFrame([(1,), (2,), (9,), (1,)], "run_id long"))
    assert {tuple(r) for r in outcomes.collect()} == {(1, "deleted"), (2, "skipped"), (9, "missing")} and {r.run_id for r in left.collect()} == {2, 3}


def test_scores_with_and_without_postings(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice([None, "", "w1 w2"])) for i in range(150)], "chunk_id long, text string, title string")
    query = spark.createDataFrame([(q, w) for q in range(5) for w in rng.sample(words, 3)], "query_id long, term string")
    fields = {"content": "text", "title": "title"}
    both = [{(r.query_id, r.chunk_id): round(r.score, 9) for r in s.collect()} for s in (search.bm25(index.postings(d, fields), query), search.bm25_texts(d, fields, query))]
    assert both[0] == both[1] and both[0]


def test_folders_with_what_hangs_on_them(spark, tmp_path):
    from corpuslens.operators import folders, index_store

    path, fields, rng = str(tmp_path / "index"), {"content": "text"}, random.Random(8)
    docs = [(i, f"f{i % 3}" if i % 4 else None, "PARSED" if i % 5 else "FAILED", f"word{i} common Alpha", 1 if i % 5 else None, True) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, folder string, status string, text string, indexed_at long, enabled boolean")
    index_store.write_segment(d.filter("status = 'PARSED'"), path, 0, fields, buckets=4)
    indexed = lambda: {r.doc_id for r in index_store.live_postings(spark, path).collect()}
    parsed = {r[0] for r in docs if r[2] == "PARSED"}
    own = {r[0] for r in docs if r[1] == "f1"}
    assert indexed() == parsed
    for _ in range(2):  # again, as after a crash
        off = folders.disable(d, "f1", path, 1, fields, buckets=4)
        assert indexed() == parsed - own
    assert {r.doc_id for r in off.filter("NOT enabled").collect()} == own == {r.doc_id for r in off.filter("indexed_at IS NULL AND status = 'PARSED'").collect()} | (own - parsed)
    on = folders.enable(off, "f1", path, 2, fields, F.lit(7).cast("long"), buckets=4)
    assert indexed() == parsed and {r.doc_id for r in on.filter("indexed_at = 7").collect()} == own & parsed
    parsed_rows = graph.parse_extractions(spark.createDataFrame([extraction(i, rng) for i in range(30)], SCHEMA))
    node_ev, edge_ev = graph.evidence(parsed_rows)
    tables = {"documents": on, "chunks": d.select("doc_id", "text"), "node_partials": graph.node_partials(node_ev), "edge_partials": graph.edge_partials(edge_ev)}
    tables |= {"nodes": graph.nodes_of(tables["node_partials"]), "edges": graph.edges_of(tables["edge_partials"])}
    left = folders.delete(tables, "f1", path, 3, fields, buckets=4)
    assert indexed() == parsed - own and {r.doc_id for r in left["documents"].collect()} == {r.doc_id for r in left["chunks"].collect()} == {r[0] for r in docs} - own
    nodes, edges, _ = graph.merge(parsed_rows.filter(~F.col("document_id").isin(*own)))
    assert rows(left["nodes"]) == rows(nodes.select(*left["nodes"].columns)) and rows(left["edges"]) == rows(edges.select(*left["edges"].columns))
