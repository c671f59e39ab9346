"""The jobs as queries over the whole tables: each is run twice, into one new folder that is left where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.plans.relational_queries import VERSION_SQL
from corpuslens.plans.text_queries import CHUNKS_SQL, TERMS_SQL
from corpuslens.session import shared_folder
from corpuslens.sources.adapt import DOCUMENTS_SQL
from jobs import corpus_report, index_documents


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        out = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return out


def job2_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2")
    for _ in range(2):
        out = corpus_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/report")
    return out


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_corpus_report)}
REPORT_SQL = f"""
WITH {DOCUMENTS_SQL}, {CHUNKS_SQL}, named AS (
  SELECT doc_id, folder, replace(file_name, '_', '-') AS file_name, status, enabled AND status = 'PARSED' AS searchable, sha256(text) AS content_hash, regexp_replace(replace(file_name, '_', '-'), '\\.[^.]*$', '') AS b FROM docs
), keyed AS (SELECT *, CASE WHEN regexp_matches(lower(b), '\\bv\\d+\\b') THEN {VERSION_SQL} END AS f FROM named
), families AS (SELECT f, count(DISTINCT content_hash) AS contents FROM keyed WHERE searchable AND length(f) >= 2 GROUP BY f HAVING count(*) > 1
), sized AS (SELECT doc_id, count(*) AS chunks, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM chunks GROUP BY doc_id
), copies AS (SELECT content_hash, count(*) AS n, min(doc_id) AS first_id FROM keyed WHERE searchable GROUP BY content_hash)
SELECT k.doc_id, folder, file_name, status, searchable, k.content_hash, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens,
  CASE WHEN searchable THEN n END AS copies, CASE WHEN searchable AND n > 1 THEN first_id END AS first_id, CASE WHEN searchable THEN coalesce(contents, 1) END AS versions
FROM keyed k LEFT JOIN copies c ON k.content_hash = c.content_hash LEFT JOIN families USING (f) LEFT JOIN sized s ON s.doc_id = k.doc_id"""
ORACLE_SQL = {
    "job1_index_documents": f"SELECT 'content' AS field, term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL.format('text')}) AS term FROM documents) GROUP BY term, doc_id",
    "job2_corpus_report": REPORT_SQL,
}
