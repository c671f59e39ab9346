"""Corpus health: roll-ups, issues, duplicates, version conflicts, freshness, change classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T

MAX_EXAMPLES = 5

#: Issue code, severity, action and what counts it, in the order they are reported.
FOLDER_ISSUES = [
    ("FOLDER_NOT_FOUND", "ERROR", "DELETE_FOLDER", "not_found"),
    ("NO_DOCUMENTS", "WARNING", "SYNC_FOLDER", "no_documents"),
    ("PARSE_FAILED", "WARNING", "SYNC_FOLDER", "failed"),
    ("UNINDEXED_DOCUMENTS", "ERROR", "REPAIR_INDEX", "unindexed"),
    ("MISSING_LOCAL_FILES", "WARNING", "SYNC_FOLDER", "missing"),
    ("STALE_LOCAL_FILES", "WARNING", "SYNC_FOLDER", "stale"),
    ("NEW_LOCAL_FILES", "WARNING", "SYNC_FOLDER", "new_files"),
]


def folder_summary(docs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Each folder's counts of documents by state, its chunks, and its latest times; chunks are counted first."""
    if chunks is not None:
        n = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"))
        docs = docs.join(n, "doc_id", "left")
    else:
        docs = docs.withColumn("_n", F.lit(0))
    parsed = F.col("status") == "PARSED"
    return docs.groupBy("folder").agg(
        F.bool_and("enabled").alias("enabled"), F.count("doc_id").alias("documents"), F.count_if(parsed).alias("parsed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(parsed & F.col("indexed_at").isNotNull()).alias("indexed"), F.count_if(parsed & F.col("indexed_at").isNull()).alias("unindexed"),
        F.coalesce(F.sum(F.when(parsed, F.coalesce("_n", F.lit(0)))), F.lit(0)).cast("long").alias("chunks"),
        F.max("indexed_at").alias("last_indexed_at"), F.max("updated_at").alias("last_updated_at"),
    )


def probe(records: DataFrame, scan: DataFrame) -> DataFrame:
    """Recorded files against scanned ones: (id, folder, state) with MISSING, STALE, NEW or SAME.

    Both have id, folder, size and modified; a recorded file that can't be read counts as stale.
    """
    a = records.select("id", "folder", F.col("size").alias("_s"), F.col("modified").alias("_m"), F.lit(True).alias("_a"))
    b = scan.select(F.col("id").alias("_id"), F.col("folder").alias("_f"), "size", "modified", F.lit(True).alias("_b"))
    same = F.col("size").eqNullSafe(F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m")) & F.col("size").isNotNull()
    state = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "NEW").when(same, "SAME").otherwise("STALE")
    return a.join(b, F.col("id") == F.col("_id"), "full").select(F.coalesce("id", "_id").alias("id"), F.coalesce("folder", "_f").alias("folder"), state.alias("state"))


def classify_changes(scan: DataFrame, records: DataFrame) -> DataFrame:
    """What an ingest does with each scanned file: new, changed, reindex (unchanged but unindexed) or skip."""
    r = records.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("hash").alias("_hash"), "status", "indexed_at")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")) & F.col("hash").eqNullSafe(F.col("_hash")) & (F.col("status") == "PARSED")
    kind = F.when(F.col("_id").isNull(), "new").when(~F.coalesce(same, F.lit(False)), "changed").when(F.col("indexed_at").isNull(), "reindex").otherwise("skip")
    return scan.join(r, F.col("id") == F.col("_id"), "left").select("id", kind.alias("change"))


def with_probe(summary: DataFrame, probed: DataFrame) -> DataFrame:
    """A folder summary with its counts of missing, stale and new files."""
    p = probed.groupBy("folder").agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("MISSING", "missing"), ("STALE", "stale"), ("NEW", "new_files"))])
    out = summary.join(p, "folder", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("missing", "stale", "new_files")})


def folder_issues(summary: DataFrame) -> DataFrame:
    """(folder, code, severity, action, count, pos) of each issue of an enabled folder."""
    counts = {
        "not_found": F.when(F.col("found"), 0).otherwise(1) if "found" in summary.columns else F.lit(0),
        "no_documents": ((F.col("documents") == 0) & (F.col("new_files") == 0)).cast("int"),
    }
    found = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), counts.get(c, F.col(c)).cast("long").alias("count"))
            for i, (code, severity, action, c) in enumerate(FOLDER_ISSUES)
            if c in counts or c in summary.columns
        ]
    )
    return summary.filter("enabled").select("folder", F.explode(F.filter(found, lambda x: x["count"] > 0)).alias("i")).select("folder", "i.*")


def folder_status(summary: DataFrame, issues: DataFrame) -> DataFrame:
    """(folder, health): DISABLED before ERROR before WARNING before EMPTY before HEALTHY."""
    worst = issues.groupBy("folder").agg(F.bool_or(F.col("severity") == "ERROR").alias("_e"), F.bool_or(F.col("severity") == "WARNING").alias("_w"))
    health = F.when(~F.col("enabled"), "DISABLED").when(F.col("_e"), "ERROR").when(F.col("_w"), "WARNING").when(F.col("documents") == 0, "EMPTY").otherwise("HEALTHY")
    return summary.join(worst, "folder", "left").select("folder", health.alias("health"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Issues merged by code: counts summed, first severity and action, errors first, then in order of code."""
    first = issues.groupBy("code").agg(F.sum("count").alias("count"), F.min_by("severity", "pos").alias("severity"), F.min_by("action", "pos").alias("action"), F.min("pos").alias("pos"))
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return first.orderBy(rank, "pos").select("code", "severity", "action", "count")


def corpus_summary(summary: DataFrame) -> DataFrame:
    """One row over all folders; folders that are off count only for the latest times."""
    on = F.col("enabled")
    total = lambda c: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long").alias(c)
    return summary.agg(
        F.count("*").alias("folders"), F.count_if(on).alias("enabled_folders"), *[total(c) for c in ("documents", "parsed", "failed", "indexed", "unindexed", "chunks")],
        F.max("last_indexed_at").alias("last_indexed_at"), F.max("last_updated_at").alias("last_updated_at"),
    )


def corpus_status(summary: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: the worst state of the folders that are on; a corpus without documents is EMPTY."""
    s = summary.join(statuses, "folder").agg(
        F.coalesce(F.sum(F.when(F.col("enabled"), F.col("documents"))), F.lit(0)).alias("n"),
        F.bool_or(F.col("health") == "ERROR").alias("e"), F.bool_or(F.col("health") == "WARNING").alias("w"),
    )
    return s.select(F.when(F.col("e"), "ERROR").when(F.col("w"), "WARNING").when(F.col("n") == 0, "EMPTY").otherwise("HEALTHY").alias("health"))


def _live(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("enabled") & (F.col("status") == "PARSED"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(hash, copies, first_id) of texts that more than one live document has; :func:`capped_examples` names a few."""
    rows = _live(docs).select("doc_id", T.content_hash("text").alias("hash")).filter(~T.is_blank("hash"))
    groups = rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return groups.filter("copies > 1")


def capped_examples(rows: DataFrame, group: str, value: str, most: int = MAX_EXAMPLES) -> DataFrame:
    """(group, examples): the first ``most`` values of each group, in order.

    Values are thinned inside hash slices of a group first, so that no task holds a whole hot group.
    """
    part = F.pmod(F.xxhash64(value), F.lit(64))
    thin = rows.select(group, value).withColumn("_s", part)
    thin = thin.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_s").orderBy(value))).filter(F.col("_r") <= most)
    return thin.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(value)), 1, most).alias("examples"))


def version_conflicts(docs: DataFrame, name: str = "file_name") -> DataFrame:
    """(family, documents, contents) of version families with more than one document and more than one content."""
    rows = _live(docs).select(T.version_family(name).alias("family"), T.content_hash("text").alias("hash")).filter("family IS NOT NULL")
    per = rows.groupBy("family", "hash").agg(F.count("*").alias("n"))
    return per.groupBy("family").agg(F.sum("n").cast("long").alias("documents"), F.count("hash").alias("contents")).filter("documents > 1 AND contents > 1")


def freshness(views: DataFrame, material: DataFrame) -> DataFrame:
    """(scope, stale): whether a view is older than the latest change of its scope's documents."""
    newest = material.groupBy(F.col("folder").alias("_s")).agg(F.max(F.greatest("updated_at", "indexed_at")).alias("_t"))
    return views.join(newest, F.col("scope") == F.col("_s"), "left").select("scope", F.coalesce(F.col("generated_at") < F.col("_t"), F.lit(False)).alias("stale"))


def index_consistency(expected_docs: DataFrame, index_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: documents and chunks that should be indexed, those that are, and whether they agree."""
    a = expected_docs.agg(F.count("*").alias("expected_documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("expected_chunks"))
    b = index_rows.agg(F.count_distinct(key).alias("indexed_documents"), F.count("*").alias("indexed_chunks"))
    same = (F.col("expected_documents") == F.col("indexed_documents")) & (F.col("expected_chunks") == F.col("indexed_chunks"))
    return a.join(F.broadcast(b)).withColumn("consistent", same)


def system_issues(summary: DataFrame, consistency: DataFrame, duplicates: DataFrame, versions: DataFrame, stale: DataFrame, embedding: bool) -> DataFrame:
    """(code, severity, action, count) of what is wrong with the corpus as a whole; each part is one small row."""
    parts = [
        ("INDEX_INCONSISTENT", "ERROR", "REBUILD_INDEX", consistency.agg(F.count_if(~F.col("consistent")).alias("n"))),
        ("EMBEDDING_UNCONFIGURED", "WARNING", "CONFIGURE_EMBEDDING", summary.agg((F.coalesce(F.sum(F.when(F.col("enabled"), F.col("documents"))), F.lit(0)) > 0).cast("int").alias("n")).withColumn("n", F.lit(0) if embedding else F.col("n"))),
        ("GRAPH_STALE", "WARNING", "REBUILD_GRAPH", stale.agg(F.count_if("stale").alias("n"))),
        ("DUPLICATE_DOCUMENT_CONTENT", "WARNING", "VIEW_CONFLICTS", duplicates.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))),
        ("POSSIBLE_VERSION_CONFLICT", "WARNING", "VIEW_CONFLICTS", versions.agg(F.count("*").alias("n"))),
    ]
    out = None
    for code, severity, action, rows in parts:
        one = rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), F.col("n").cast("long").alias("count"))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("count") > 0)


def answer_readiness(summary: DataFrame, consistency: DataFrame, duplicates: DataFrame, versions: DataFrame, embedding: bool) -> DataFrame:
    """One row: searchable documents, counts of issues by kind, and whether answers can be trusted.

    ``summary`` has a row for each folder with its probe, of which those that are on count.  Ready means that there
    are documents, some can be searched, none has failed or waits for the index, no file differs, and the index agrees.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    row = summary.filter("enabled").agg(*map(total, ("documents", "parsed", "failed", "unindexed", "missing", "stale", "new_files")))
    row = row.join(F.broadcast(consistency.select("consistent"))).join(F.broadcast(duplicates.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))))
    row = row.join(F.broadcast(versions.agg(F.count("*").alias("families"))))  # one row each
    searchable = F.greatest(F.lit(0), F.col("parsed") - F.col("unindexed")).cast("long")
    sync = F.col("missing") + F.col("stale") + F.col("new_files")
    no_embedding = F.lit(0) if embedding else (F.col("documents") > 0).cast("int")
    retrieval = F.col("failed") + F.col("unindexed") + (~F.col("consistent")).cast("int") + no_embedding
    ready = (F.col("documents") > 0) & (searchable > 0) & (sync == 0) & (F.col("failed") == 0) & (F.col("unindexed") == 0) & F.col("consistent")
    return row.select(searchable.alias("searchable"), sync.alias("sync"), retrieval.alias("retrieval"), (F.col("copies") + F.col("families")).cast("long").alias("conflicts"), ready.alias("ready"))


def problem_documents(docs: DataFrame, probed: DataFrame) -> DataFrame:
    """(problem, id): failed and unindexed documents of folders that are on, and missing, stale and new files."""
    on = docs.filter("enabled")
    failed = on.filter("status = 'FAILED'").select(F.lit("FAILED").alias("problem"), F.col("doc_id").alias("id"))
    waiting = on.filter("status = 'PARSED' AND indexed_at IS NULL").select(F.lit("UNINDEXED").alias("problem"), F.col("doc_id").alias("id"))
    return failed.unionByName(waiting).unionByName(probed.filter("state <> 'SAME'").select(F.col("state").alias("problem"), "id"))


def ingest_summary(results: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """One row of an ingest: scanned, parsed, skipped and failed files, and the first few failures by file name."""
    counts = results.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("status") == "PARSED").alias("parsed"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )
    few = results.filter("status = 'FAILED'").orderBy("file_name").limit(most).agg(F.array_sort(F.collect_list(F.struct("file_name", "error"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat_ws(": ", x["file_name"], x["error"])), "; ")
    return counts.join(F.broadcast(few)).select("scanned", "parsed", "skipped", "failed", text.alias("failures"))
