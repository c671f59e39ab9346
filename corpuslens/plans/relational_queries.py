"""Queries over relational building blocks and corpus health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import chunk, health
from corpuslens.operators import relational as R
from corpuslens.plans.registry import ORACLE_SQL, query
from corpuslens.plans.text_queries import CHUNKS_SQL
from corpuslens.sources import adapt
from corpuslens.sources.adapt import DOCUMENTS_SQL, RUNS_SQL, table


@query("SELECT o_orderkey, count(l_orderkey) AS n_children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def docs_with_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_child_count(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


FOLDERS_SQL = f"""{DOCUMENTS_SQL}, {CHUNKS_SQL}, per AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
folders AS (
  SELECT folder, bool_and(enabled) AS enabled, count(doc_id) AS documents, count(*) FILTER (WHERE status = 'PARSED') AS parsed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
    count(*) FILTER (WHERE status = 'PARSED' AND indexed_at IS NOT NULL) AS indexed, count(*) FILTER (WHERE status = 'PARSED' AND indexed_at IS NULL) AS unindexed,
    CAST(coalesce(sum(CASE WHEN status = 'PARSED' THEN coalesce(n, 0) END), 0) AS BIGINT) AS chunks, max(indexed_at) AS last_indexed_at, max(updated_at) AS last_updated_at
  FROM docs LEFT JOIN per USING (doc_id) GROUP BY folder
)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir)
    return health.folder_summary(d, chunk.chunk_plain(d).select("doc_id"))


@query(f"WITH {FOLDERS_SQL} SELECT * FROM folders")
def folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query(f"WITH {FOLDERS_SQL} SELECT * FROM folders ORDER BY documents DESC, folder LIMIT 3 OFFSET 3")
def folders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of three of the folders with most documents."""
    return R.page(_summary(spark, sf_dir), 2, 3, F.desc("documents"), F.col("folder"))


@query("""WITH old AS (SELECT s_name AS folder_path, s_suppkey AS id, s_nationkey AS enabled, 1 AS created_at, 1 AS updated_at FROM supplier),
new AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || '/new' END AS folder_path, s_suppkey + 1000000 AS id, -1 AS enabled, 2 AS created_at, 2 AS updated_at FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.folder_path, n.folder_path) AS folder_path, coalesce(o.id, n.id) AS id, coalesce(n.enabled, o.enabled) AS enabled, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM old o FULL JOIN new n ON o.folder_path = n.folder_path""")
def folder_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders merged by their paths: known ones keep their ids and times of creation."""
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_name").alias("folder_path"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("enabled"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    path = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("/new")))
    new = s.filter("s_suppkey % 2 = 0").select(path.alias("folder_path"), (F.col("s_suppkey") + 1_000_000).alias("id"), F.lit(-1).cast("long").alias("enabled"), F.lit(2).alias("created_at"), F.lit(2).alias("updated_at"))
    return R.upsert_stored("folders", old, new)


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def defaulted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection with defaults for what is missing."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return R.defaulted(table(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id", "left"), {"quality": -1, "toxic": 0})


@query("""SELECT c_custkey, count(o.o_orderkey) AS orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished
FROM customer LEFT JOIN orders o ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o.o_orderkey GROUP BY c_custkey""")
def nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, children and grandchildren counted level by level, so that no join multiplies rows."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("n").alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("orders", "items", "finished")])


@query(f"WITH {DOCUMENTS_SQL} SELECT doc_id, folder, file_name FROM docs WHERE (folder IS NULL OR enabled) AND status = 'PARSED'")
def searchable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.documents(spark, sf_dir).filter((F.col("folder").isNull() | F.col("enabled")) & (F.col("status") == "PARSED")).select("doc_id", "folder", "file_name")


@query(f"WITH {RUNS_SQL} SELECT r.* FROM runs r WHERE created_at = (SELECT max(created_at) FROM runs x WHERE x.scope_type = r.scope_type AND x.scope_id IS NOT DISTINCT FROM r.scope_id)")
def latest_run_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_with_ties(adapt.runs(spark, sf_dir), ["scope_type", "scope_id"], "created_at")


@query(f"WITH {RUNS_SQL} SELECT status, run_id, created_at FROM runs QUALIFY row_number() OVER (PARTITION BY status ORDER BY created_at DESC, run_id DESC) = 1")
def latest_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_single(adapt.runs(spark, sf_dir), ["status"], "created_at", "run_id").select("status", "run_id", "created_at")


_PAGE = "scope_type = 'KNOWLEDGE_FOLDER' AND status IN ('click', 'view', 'purchase') AND lower(current_item) LIKE '%1%' AND coalesce(completed_at, started_at, queued_at, created_at) >= 1704500000000"


def _filtered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.runs(spark, sf_dir)
    return rows.filter(
        R.all_of(F.col("scope_type") == "KNOWLEDGE_FOLDER", F.col("status").isin("click", "view", "purchase"), R.keyword_filter(" 1 ", "current_item"), R.effective_time() >= 1704500000000)
    )


@query(f"WITH {RUNS_SQL} SELECT * FROM runs WHERE {_PAGE} ORDER BY coalesce(completed_at, started_at, queued_at, created_at) DESC, run_id LIMIT 20 OFFSET 20")
def runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(_filtered_runs(spark, sf_dir), 2, 20, R.effective_time().desc(), F.col("run_id"))


@query(f"WITH {RUNS_SQL} SELECT count(*) AS total FROM runs WHERE {_PAGE}")
def runs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered_runs(spark, sf_dir).agg(F.count("*").alias("total"))


@query(f"""WITH {RUNS_SQL} SELECT run_id, coalesce(completed_at, started_at, queued_at, created_at) AS effective_at,
  CASE WHEN started_at IS NULL OR completed_at IS NULL THEN 0 ELSE greatest(0, completed_at - started_at) END AS duration_ms FROM runs""")
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.runs(spark, sf_dir).select("run_id", R.effective_time().alias("effective_at"), R.duration().alias("duration_ms"))


@query(f"WITH {RUNS_SQL} SELECT run_id, CAST(row_number() OVER (ORDER BY queued_at NULLS FIRST, created_at, run_id) AS INT) AS position FROM runs WHERE status = 'signup'")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = adapt.runs(spark, sf_dir).filter("status = 'signup'")
    return R.queue_positions(queued, "queued_at", "created_at", "run_id").select("run_id", "position")


@query(f"WITH {RUNS_SQL} SELECT run_id, status FROM runs ORDER BY CASE WHEN status = 'purchase' THEN 0 WHEN status = 'click' THEN 1 ELSE 2 END, queued_at NULLS FIRST, created_at, run_id")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("status") == "purchase", 0).when(F.col("status") == "click", 1).otherwise(2)
    return adapt.runs(spark, sf_dir).orderBy(rank, F.col("queued_at").asc_nulls_first(), "created_at", "run_id").select("run_id", "status")


@query("WITH ids AS (SELECT CAST((i * 37) % 1000 AS BIGINT) AS doc_id, i AS pos FROM range(0, 500) t(i)) SELECT d.doc_id, lang, CAST(pos AS INT) AS pos FROM documents d JOIN ids USING (doc_id)")
def ordered_in_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [(i * 37) % 1000 for i in range(600)]
    return R.ordered_lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@query(f"WITH {RUNS_SQL} SELECT run_id, count(*) OVER (PARTITION BY scope_type, scope_id) AS same_scope FROM runs")
def scope_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same scope, null ids being equal; scopes are counted before the join."""
    rows = adapt.runs(spark, sf_dir)
    n = rows.groupBy(F.col("scope_type").alias("_t"), F.col("scope_id").alias("_i")).agg(F.count("*").alias("same_scope"))
    return rows.join(n, (F.col("scope_type") == F.col("_t")) & R.same_scope(F.col("scope_id"), F.col("_i"))).select("run_id", "same_scope")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (
  SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
  AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def scoped_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when rows of a scope are deleted; the disjunction of sub-queries is one anti join after the other."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    region = F.broadcast(table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey"))  # a few nations
    scope = o.join(c.join(region, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    for gone in (scope, o.filter("o_orderstatus = 'P'").select("o_orderkey")):
        rows = rows.join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return rows


@query(f"WITH {RUNS_SQL} SELECT status IN ('purchase', 'signup') AS deleted, count(*) AS n, min(run_id) AS first_id FROM runs GROUP BY 1")
def terminal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.runs(spark, sf_dir)
    return rows.groupBy(F.col("status").isin("purchase", "signup").alias("deleted")).agg(F.count("*").alias("n"), F.min("run_id").alias("first_id"))


@query("""WITH r AS (SELECT event_id AS run_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' ELSE 'QUEUED' END AS status FROM events),
asked AS (SELECT run_id + CASE WHEN run_id % 10 = 0 THEN 100000000 ELSE 0 END AS run_id FROM r WHERE run_id % 2 = 0)
SELECT a.run_id, CASE WHEN r.run_id IS NULL THEN 'missing' WHEN status IN ('COMPLETED', 'FAILED') THEN 'deleted' ELSE 'skipped' END AS outcome FROM asked a LEFT JOIN r USING (run_id)
UNION ALL SELECT run_id, 'left' FROM r WHERE NOT (status IN ('COMPLETED', 'FAILED') AND run_id % 2 = 0 AND run_id % 10 <> 0)""")
def run_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each run that is to be deleted, and the runs that are left."""
    from corpuslens.streaming import runs as run_control

    kind = F.col("event_type")
    status = F.when(kind == "purchase", "COMPLETED").when(kind == "signup", "FAILED").when(kind == "click", "RUNNING").otherwise("QUEUED")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), status.alias("status"))
    asked = rows.filter("run_id % 2 = 0").select((F.col("run_id") + F.when(F.col("run_id") % 10 == 0, 100_000_000).otherwise(0)).alias("run_id"))
    left, outcomes = run_control.delete_runs(rows, asked)
    return outcomes.unionByName(left.select("run_id", F.lit("left").alias("outcome")))


@query("""WITH s AS (SELECT o_orderkey + 10 AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
  CASE WHEN t.o_orderkey IS NOT NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus
FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) t FULL JOIN s ON t.o_orderkey = s.o_orderkey""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    s = t.filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 10).alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    return R.upsert(t, s, "o_orderkey", keep=("o_orderstatus",), prefer_new=("o_custkey",))


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 7, 'N' FROM orders WHERE o_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.insert_ignore(t, t.select((F.col("o_orderkey") + 7).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")), "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
UNION ALL SELECT DISTINCT l_orderkey, 0, 1 FROM lineitem WHERE l_orderkey % 10 = 0""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"))
    new = rows.filter("l_orderkey % 10 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return R.replace_children(rows, new, "l_orderkey")


@query("""SELECT conv_id, text, coalesce(m, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq
FROM (SELECT * FROM conversations WHERE role = 'user') LEFT JOIN (SELECT conv_id, max(turn + 1) AS m FROM conversations GROUP BY conv_id) USING (conv_id)""")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapt.messages(spark, sf_dir)
    new = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "text", "turn")
    return R.next_sequence(log, new, "conv_id", "seq", "turn").select("conv_id", "text", F.col("seq").cast("long").alias("seq"))


@query(f"WITH {DOCUMENTS_SQL} SELECT folder, bool_and(indexed_at IS NOT NULL) AS all_indexed FROM docs GROUP BY folder")
def all_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.every_flag(adapt.documents(spark, sf_dir), ["folder"], F.col("indexed_at").isNotNull(), "all_indexed")


@query(f"WITH {DOCUMENTS_SQL} SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM docs WHERE enabled AND status = 'PARSED' GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.duplicate_groups(adapt.documents(spark, sf_dir))


@query(f"""WITH {DOCUMENTS_SQL}, live AS (SELECT doc_id, sha256(text) AS hash FROM docs WHERE enabled AND status = 'PARSED'),
ranked AS (SELECT hash, doc_id, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY hash) AS n FROM live)
SELECT hash, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM ranked WHERE n > 1 AND r <= 5 GROUP BY hash""")
def duplicate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir)
    live = d.filter("enabled AND status = 'PARSED'").select("doc_id", T.content_hash("text").alias("hash"))
    groups = health.duplicate_groups(d).select("hash")
    few = health.capped_examples(live.join(groups, "hash", "left_semi"), "hash", "doc_id")
    return few.select("hash", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


VERSION_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(b), '()[]_-.', '       '), '\b(v\d+(\.\d+)*|final|draft)\b', ' ', 'g'), '\b\d{4}(\d{2})?(\d{2})?\b', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"""WITH {DOCUMENTS_SQL}, named AS (SELECT text, regexp_replace(replace(file_name, '_v', '-v'), '_', '-', 'g') AS f FROM docs WHERE enabled AND status = 'PARSED'),
based AS (SELECT text, regexp_replace(f, '\\.[^.]*$', '') AS b FROM named),
keyed AS (SELECT text, {VERSION_SQL} AS family FROM based WHERE regexp_matches(lower(b), '\\bv\\d+\\b'))
SELECT family, count(*) AS documents, count(DISTINCT sha256(text)) AS contents FROM keyed WHERE length(family) >= 2 GROUP BY family HAVING count(*) > 1 AND count(DISTINCT text) > 1""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir).withColumn("file_name", F.replace("file_name", F.lit("_"), F.lit("-")))
    return health.version_conflicts(d)


RECORDS_SQL = """scan AS (SELECT doc_id AS id, source AS folder, n_chars AS size, 1000 + doc_id AS modified, sha256(text) AS hash FROM documents),
records AS (
  SELECT doc_id AS id, source AS folder, n_chars AS size, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1000 + doc_id END AS modified,
    CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS hash, CASE WHEN doc_id % 19 = 0 THEN 'FAILED' ELSE 'PARSED' END AS status,
    CASE WHEN doc_id % 5 <> 0 THEN 1 END AS indexed_at
  FROM documents WHERE doc_id % 17 <> 0
  UNION ALL SELECT doc_id + 1000000, source, n_chars, 0, 'gone', 'PARSED', 1 FROM documents WHERE doc_id % 29 = 0
)"""


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scan of the documents, and a record of them that differs: rows left out, changed and gone."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    base = [i.alias("id"), F.col("source").alias("folder"), F.col("n_chars").alias("size")]
    scan = d.select(*base, (1000 + i).alias("modified"), F.sha2("text", 256).alias("hash"))
    records = d.filter("doc_id % 17 <> 0").select(
        *base, F.when(i % 13 == 0, 0).otherwise(1000 + i).alias("modified"), F.when(i % 11 == 0, "old").otherwise(F.sha2("text", 256)).alias("hash"),
        F.when(i % 19 == 0, "FAILED").otherwise("PARSED").alias("status"), F.when(i % 5 != 0, 1).alias("indexed_at"),
    )
    gone = d.filter("doc_id % 29 = 0").select((i + 1000000).alias("id"), *base[1:], F.lit(0).cast("long").alias("modified"), F.lit("gone").alias("hash"), F.lit("PARSED").alias("status"), F.lit(1).alias("indexed_at"))
    return scan, records.unionByName(gone)


@query(f"""WITH {RECORDS_SQL} SELECT s.id, CASE WHEN r.id IS NULL THEN 'new' WHEN NOT (s.size = r.size AND s.modified = r.modified AND s.hash = r.hash AND r.status = 'PARSED') THEN 'changed'
  WHEN r.indexed_at IS NULL THEN 'reindex' ELSE 'skip' END AS change FROM scan s LEFT JOIN records r USING (id)""")
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.classify_changes(*_scan(spark, sf_dir))


PROBE_SQL = f"""{RECORDS_SQL}, probed AS (
  SELECT coalesce(r.id, s.id) AS id, coalesce(r.folder, s.folder) AS folder,
    CASE WHEN s.id IS NULL THEN 'MISSING' WHEN r.id IS NULL THEN 'NEW' WHEN s.size = r.size AND s.modified = r.modified THEN 'SAME' ELSE 'STALE' END AS state
  FROM records r FULL JOIN scan s ON r.id = s.id
)"""


@query(f"WITH {PROBE_SQL} SELECT * FROM probed")
def file_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, records = _scan(spark, sf_dir)
    return health.probe(records, scan)


def probed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, records = _scan(spark, sf_dir)
    return health.with_probe(_summary(spark, sf_dir), health.probe(records, scan))


ISSUES_SQL = f"""{FOLDERS_SQL}, {PROBE_SQL}, probes AS (
  SELECT folder, count(*) FILTER (WHERE state = 'MISSING') AS missing, count(*) FILTER (WHERE state = 'STALE') AS stale, count(*) FILTER (WHERE state = 'NEW') AS new_files FROM probed GROUP BY folder
), full_folders AS (SELECT f.*, coalesce(missing, 0) AS missing, coalesce(stale, 0) AS stale, coalesce(new_files, 0) AS new_files FROM folders f LEFT JOIN probes USING (folder)),
issues AS (
  SELECT folder, pos, code, severity, action, CAST(n AS BIGINT) AS count FROM (
    SELECT folder, 1 AS pos, 'NO_DOCUMENTS' AS code, 'WARNING' AS severity, 'SYNC_FOLDER' AS action, CASE WHEN documents = 0 AND new_files = 0 THEN 1 ELSE 0 END AS n FROM full_folders WHERE enabled
    UNION ALL SELECT folder, 2, 'PARSE_FAILED', 'WARNING', 'SYNC_FOLDER', failed FROM full_folders WHERE enabled
    UNION ALL SELECT folder, 3, 'UNINDEXED_DOCUMENTS', 'ERROR', 'REPAIR_INDEX', unindexed FROM full_folders WHERE enabled
    UNION ALL SELECT folder, 4, 'MISSING_LOCAL_FILES', 'WARNING', 'SYNC_FOLDER', missing FROM full_folders WHERE enabled
    UNION ALL SELECT folder, 5, 'STALE_LOCAL_FILES', 'WARNING', 'SYNC_FOLDER', stale FROM full_folders WHERE enabled
    UNION ALL SELECT folder, 6, 'NEW_LOCAL_FILES', 'WARNING', 'SYNC_FOLDER', new_files FROM full_folders WHERE enabled
  ) WHERE n > 0
)"""


@query(f"WITH {ISSUES_SQL} SELECT * FROM issues")
def folder_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.folder_issues(probed_summary(spark, sf_dir))


@query(f"""WITH {ISSUES_SQL} SELECT f.folder, CASE WHEN NOT enabled THEN 'DISABLED' WHEN e THEN 'ERROR' WHEN w THEN 'WARNING' WHEN documents = 0 THEN 'EMPTY' ELSE 'HEALTHY' END AS health
FROM full_folders f LEFT JOIN (SELECT folder, bool_or(severity = 'ERROR') AS e, bool_or(severity = 'WARNING') AS w FROM issues GROUP BY folder) USING (folder)""")
def folder_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = probed_summary(spark, sf_dir)
    return health.folder_status(s, health.folder_issues(s))


@query(f"WITH {ISSUES_SQL} SELECT code, min_by(severity, pos) AS severity, min_by(action, pos) AS action, CAST(sum(count) AS BIGINT) AS count FROM issues GROUP BY code")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.issue_rollup(health.folder_issues(probed_summary(spark, sf_dir)))


@query(f"""WITH {FOLDERS_SQL} SELECT count(*) AS folders, count(*) FILTER (WHERE enabled) AS enabled_folders, {', '.join(f"CAST(coalesce(sum(CASE WHEN enabled THEN {c} END), 0) AS BIGINT) AS {c}" for c in ("documents", "parsed", "failed", "indexed", "unindexed", "chunks"))},
  max(last_indexed_at) AS last_indexed_at, max(last_updated_at) AS last_updated_at FROM folders""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.corpus_summary(_summary(spark, sf_dir))


@query(f"WITH {ISSUES_SQL} SELECT CASE WHEN bool_or(severity = 'ERROR') THEN 'ERROR' WHEN count(*) > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM issues")
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = probed_summary(spark, sf_dir)
    return health.corpus_status(s, health.folder_status(s, health.folder_issues(s)))


@query(f"""WITH {DOCUMENTS_SQL}, views AS (SELECT folder AS scope, {adapt.EPOCH} + count(*) * 9000 AS generated_at FROM docs GROUP BY folder),
newest AS (SELECT folder, max(greatest(updated_at, coalesce(indexed_at, 0))) AS t FROM docs GROUP BY folder)
SELECT scope, coalesce(generated_at < t, false) AS stale FROM views LEFT JOIN newest ON scope = folder""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir)
    views = d.groupBy(F.col("folder").alias("scope")).agg((F.lit(adapt.EPOCH) + F.count("*") * 9000).alias("generated_at"))
    return health.freshness(views, d)


@query(f"""WITH {DOCUMENTS_SQL}, {CHUNKS_SQL}, per AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id), live AS (SELECT doc_id, n FROM docs JOIN per USING (doc_id) WHERE enabled AND status = 'PARSED')
SELECT expected_documents, expected_chunks, indexed_documents, indexed_chunks, expected_documents = indexed_documents AND expected_chunks = indexed_chunks AS consistent
FROM (SELECT count(*) AS expected_documents, CAST(sum(n) AS BIGINT) AS expected_chunks FROM live),
  (SELECT count(DISTINCT doc_id) AS indexed_documents, count(*) AS indexed_chunks FROM chunks JOIN docs USING (doc_id) WHERE enabled AND status = 'PARSED' AND doc_id % 50 <> 0)""")
def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = adapt.documents(spark, sf_dir).filter("enabled AND status = 'PARSED'")
    n = F.size(chunk.windows(T.clean_prose("text")))
    return health.index_consistency(live.select("doc_id", n.alias("n_chunks")).filter("n_chunks > 0"), chunk.chunk_plain(live.filter("doc_id % 50 <> 0")))


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%a%' OR regexp_matches(lower(p_name), 'a')) AND (lower(p_name) LIKE '%ee%' OR regexp_matches(lower(p_name), 'e.*e'))")
def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(R.fuzzy_terms(F.col("p_name"), "a ee")).select("p_partkey", "p_name")


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024.0 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(b / 1048576.0 * 10 + 0.5) / 10) || ' MB' END AS size FROM (SELECT doc_id, n_chars AS b FROM documents)")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_size("n_chars").alias("size"))
