"""The jobs: whole tables against SQL, two runs over growing input, reruns, and what a crash leaves."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import index_store
from jobs import common, corpus_report, index_documents, queries
from tests.test_oracle import TABLES, plain

SF, ROOT = "/root/testdata/sf0.01", Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_give_what_their_sql_gives(name, spark):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def postings(df):
    return {(r.term, r.doc_id, r.tf) for r in df.collect()}


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(path))


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, index, check = (str(tmp_path / n) for n in ("docs", "index", "check"))
    run = lambda: index_documents.run(spark, docs, index, check, buckets=4)
    write(spark, [(1, "Red red fox", "a"), (2, "blue", "a"), (None, "lost", "a"), (3, "", "b")], docs)
    caplog.set_level("INFO")
    assert postings(run()) == {("red", 1, 2), ("fox", 1, 1), ("blue", 2, 1)}
    assert "read 4 rows" in caplog.text and "wrote 3 documents and 3 postings" in caplog.text
    caplog.clear()
    write(spark, [(1, "green fox", "a"), (2, None, "a"), (4, "red", "b"), (4, "also", "b")], docs)
    assert postings(run()) == {("green", 1, 1), ("fox", 1, 1), ("red", 4, 1)}  # replaced, deleted, added
    assert "read 4 rows" in caplog.text and "wrote 3 documents" in caplog.text  # the first file isn't read again
    caplog.clear()
    before = sorted(str(p) for p in (tmp_path / "index").rglob("*"))
    assert postings(run()) == {("green", 1, 1), ("fox", 1, 1), ("red", 4, 1)}
    assert "batch" not in caplog.text and sorted(str(p) for p in (tmp_path / "index").rglob("*")) == before
    hits = index_store.topk(spark, index, spark.createDataFrame([(1, "fox"), (2, "red")], "query_id long, term string"), 3, buckets=4)
    assert {(r.query_id, r.doc_id) for r in hits.collect()} == {(1, 1), (2, 4)}


@pytest.mark.parametrize("step", ["postings", "blocks", "documents"])
def test_a_batch_that_crashed_is_written_again(spark, tmp_path, step):
    docs, index, check = (str(tmp_path / n) for n in ("docs", "index", "check"))
    write(spark, [(1, "one two", "a"), (2, "two", "a")], docs)
    want = postings(index_documents.run(spark, docs, index, check, buckets=4))
    # as if the run had stopped there: the batch isn't committed, and this table and the later ones aren't written
    for name in ("postings", "blocks", "documents")[("postings", "blocks", "documents").index(step) :]:
        shutil.rmtree(f"{index}/{name}")
    shutil.rmtree(f"{check}/commits")
    assert postings(index_documents.run(spark, docs, index, check, buckets=4)) == want


def test_report_of_some_folders(spark, tmp_path):
    docs, labels, target = (str(tmp_path / n) for n in ("docs", "labels", "report"))
    rows = [(i, f"text {i % 4} " * 3, f"src{i % 2}", "en") for i in range(12)] + [(12, None, "src0", "en"), (13, "text", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(docs)
    spark.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(labels)
    whole = {tuple(r) for r in corpus_report.run(spark, docs, labels, target).collect()}
    assert len(whole) == 14 and {tuple(r) for r in corpus_report.run(spark, docs, labels, target).collect()} == whole
    names = {str(p) for p in (tmp_path / "report" / "folder=src1").glob("part-*")}
    got = {tuple(r) for r in corpus_report.run(spark, docs, labels, target, folders=["src0"]).collect()}
    assert got == whole and {str(p) for p in (tmp_path / "report" / "folder=src1").glob("part-*")} == names
    by_id = {r.doc_id: r for r in corpus_report.run(spark, docs, labels, target).collect()}
    assert (by_id[4].copies, by_id[4].first_id, by_id[4].searchable) == (3, 0, True)
    assert (by_id[1].searchable, by_id[1].copies, by_id[12].chunks, by_id[13].folder) == (False, None, 0, None)


def test_settings(tmp_path):
    for job in (index_documents, corpus_report):
        path = str(ROOT / "jobs" / f"{job.__name__.split('.')[-1]}.json")
        assert common.settings_of(path, job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"unknown": 1}))
    with pytest.raises(ValueError, match="unknown"):
        common.settings_of(str(tmp_path / "c.json"), index_documents.DEFAULTS)


def test_command_line(tmp_path):
    out = [f"--{n}={tmp_path / n}" for n in ("index", "checkpoint")]
    args = [sys.executable, "-m", "jobs.index_documents", "--documents=/root/testdata/sf0.001/documents.parquet", *out, f"--config={ROOT / 'jobs' / 'index_documents.json'}"]
    got = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0 and "batch 0: read" in got.stderr, got.stderr[-2000:]
    assert (tmp_path / "index" / "documents").is_dir()
