"""Queries over system health, stored graphs and answer streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import chat, chunk, graph, health, index
from corpuslens.plans import relational_queries as RQ
from corpuslens.plans.registry import ORACLE_SQL, query
from corpuslens.plans.text_queries import CHUNKS_SQL, collapse_sql
from corpuslens.sources import adapt
from corpuslens.sources.adapt import DOCUMENTS_SQL, MESSAGES_SQL, RUNS_SQL, table
from corpuslens.streaming import runs as run_control

#: Chunks of each document, and whether its first one can't be embedded.
CHUNKED_SQL = f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS n, bool_or(doc_id % 7 = 0 AND chunk_index = 0) AS bad FROM chunks GROUP BY doc_id"


@query(f"""WITH {RUNS_SQL} SELECT run_id, f.source AS folder, f.n AS folder_documents FROM runs r
LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) f ON r.scope_type = 'KNOWLEDGE_FOLDER' AND f.source = 'src' || r.scope_id""")
def runs_with_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and their folders: the literal condition belongs to the join, so other runs stay."""
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("folder_documents"))
    on = (F.col("scope_type") == "KNOWLEDGE_FOLDER") & (F.col("folder") == F.concat(F.lit("src"), F.col("scope_id").cast("string")))
    return adapt.runs(spark, sf_dir).join(f, on, "left").select("run_id", "folder", "folder_documents")


@query(f"""WITH {RQ.PROBE_SQL}, {DOCUMENTS_SQL} SELECT 'FAILED' AS problem, doc_id AS id FROM docs WHERE enabled AND status = 'FAILED'
UNION ALL SELECT 'UNINDEXED', doc_id FROM docs WHERE enabled AND status = 'PARSED' AND indexed_at IS NULL UNION ALL SELECT state, id FROM probed WHERE state <> 'SAME'""")
def problem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.problem_documents(adapt.documents(spark, sf_dir), RQ.file_probe(spark, sf_dir))


def _count(sql: str, what: str) -> str:
    return f"(SELECT {what} FROM ({sql}))"


@query("SELECT * FROM (SELECT 'INDEX_INCONSISTENT' AS code, 'ERROR' AS severity, 'REBUILD_INDEX' AS action, CAST(1 AS BIGINT) AS count UNION ALL SELECT 'EMBEDDING_UNCONFIGURED', 'WARNING', 'CONFIGURE_EMBEDDING', 1"
       + f" UNION ALL SELECT 'GRAPH_STALE', 'WARNING', 'REBUILD_GRAPH', {_count(f'WITH {DOCUMENTS_SQL}, views AS (SELECT folder AS scope, {adapt.EPOCH} + count(*) * 9000 AS g, max(greatest(updated_at, coalesce(indexed_at, 0))) AS t FROM docs GROUP BY folder) SELECT * FROM views WHERE g < t', 'count(*)')}"
       + f" UNION ALL SELECT 'DUPLICATE_DOCUMENT_CONTENT', 'WARNING', 'VIEW_CONFLICTS', {_count(f'''WITH {DOCUMENTS_SQL} SELECT count(*) AS n FROM docs WHERE enabled AND status = 'PARSED' GROUP BY text HAVING count(*) > 1''', 'CAST(coalesce(sum(n), 0) AS BIGINT)')}"
       + f" UNION ALL SELECT 'POSSIBLE_VERSION_CONFLICT', 'WARNING', 'VIEW_CONFLICTS', {_count(str(ORACLE_SQL['version_conflicts']), 'count(*)')}) WHERE count > 0")
def system_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir)
    return health.system_issues(
        health.folder_summary(d), RQ.index_consistency(spark, sf_dir), health.duplicate_groups(d), RQ.version_conflicts(spark, sf_dir), RQ.freshness(spark, sf_dir), embedding=False
    )


@query(f"""WITH {RQ.ISSUES_SQL}, f AS (SELECT CAST(coalesce(sum(documents), 0) AS BIGINT) AS documents, CAST(coalesce(sum(parsed), 0) AS BIGINT) AS parsed, CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed,
    CAST(coalesce(sum(unindexed), 0) AS BIGINT) AS unindexed, CAST(coalesce(sum(missing + stale + new_files), 0) AS BIGINT) AS sync FROM full_folders WHERE enabled),
  i AS ({ORACLE_SQL['index_consistency']}), c AS (SELECT coalesce(sum(copies), 0) AS copies FROM ({ORACLE_SQL['duplicate_groups']})), v AS (SELECT count(*) AS families FROM ({ORACLE_SQL['version_conflicts']}))
SELECT greatest(0, parsed - unindexed) AS searchable, sync, failed + unindexed + CASE WHEN consistent THEN 0 ELSE 1 END + CASE WHEN documents > 0 THEN 1 ELSE 0 END AS retrieval, CAST(copies + families AS BIGINT) AS conflicts,
  documents > 0 AND parsed - unindexed > 0 AND sync = 0 AND failed = 0 AND unindexed = 0 AND consistent AS ready FROM f, i, c, v""")
def answer_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.documents(spark, sf_dir)
    return health.answer_readiness(RQ.probed_summary(spark, sf_dir), RQ.index_consistency(spark, sf_dir), health.duplicate_groups(d), RQ.version_conflicts(spark, sf_dir), embedding=False)


@query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN NOT (status = 'PARSED' AND indexed_at IS NULL) THEN indexed_at WHEN bad THEN NULL ELSE 5 END AS indexed_at,
  CASE WHEN status = 'PARSED' AND indexed_at IS NULL AND NOT bad THEN n END AS indexed_chunks, CASE WHEN status = 'PARSED' AND indexed_at IS NULL THEN NOT bad END AS rebuilt
FROM (SELECT docs.*, coalesce(bad, false) AS bad, coalesce(n, 0) AS n FROM docs LEFT JOIN ({CHUNKED_SQL}) p USING (doc_id))""")
def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of documents that aren't in it yet is made; a chunk that can't be embedded fails its document."""
    d = adapt.documents(spark, sf_dir)
    error = F.when((F.col("doc_id") % 7 == 0) & (F.col("chunk_index") == 0), "no embedding")
    return index.rebuild(d, chunk.chunk_plain(d).withColumn("error", error), F.col("indexed_at").isNull(), F.lit(5).cast("long")).select("doc_id", "indexed_at", "indexed_chunks", "rebuilt")


@query("""WITH g AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'KNOWLEDGE_FOLDER' ELSE 'DOCUMENT' END AS t, n_name, r_name, n_nationkey % 2 = 0 AS m FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT id FROM g WHERE contains(lower(n_name || ' ' || r_name || ' ' || t), 'a') AND t = 'DOCUMENT' AND m""")
def generated_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of generated graphs under its filter."""
    i = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(i % 3 == 0, "ALL").when(i % 3 == 1, "KNOWLEDGE_FOLDER").otherwise("DOCUMENT")
    graphs = n.select(i.alias("id"), kind.alias("scope_type"), F.col("n_name").alias("scope_name"), F.col("r_name").alias("scope_subtitle"), (i % 2 == 0).alias("has_mindmap"), (i % 2 == 1).alias("has_graph"))
    return graph.filter_generated(graphs, " A ", "DOCUMENT", "MINDMAP").select("id")


#: Regions, nations, customers and orders as the four levels of a mind map.
MAP_SQL = """nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS label, 'scope' AS kind, '' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'document', '' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'heading', '' FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority || ' ' || o_orderkey, 'entity', o_orderstatus FROM orders),
edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(f"""WITH {MAP_SQL}, hit AS (SELECT id FROM nodes WHERE (kind <> 'entity' OR type IN ('P')) AND contains(lower(label), 'urgent')), a1 AS (SELECT source AS id FROM edges WHERE target IN (FROM hit)),
a2 AS (SELECT source AS id FROM edges WHERE target IN (FROM a1)), a3 AS (SELECT source AS id FROM edges WHERE target IN (FROM a2)), below AS (SELECT target AS id FROM edges WHERE source IN (FROM hit))
SELECT id FROM nodes WHERE id IN (FROM hit UNION FROM a1 UNION FROM a2 UNION FROM a3 UNION FROM below)""")
def mind_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mind map shows of entities of one type with a word in their labels."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda df, i, label, kind, t: df.select(i.alias("id"), label.alias("label"), F.lit(kind).alias("kind"), t.alias("type"))
    none = F.lit("")
    nodes = node(r, tag("r", "r_regionkey"), F.col("r_name"), "scope", none).unionByName(node(n, tag("n", "n_nationkey"), F.col("n_name"), "document", none)).unionByName(node(c, tag("c", "c_custkey"), F.col("c_name"), "heading", none))
    nodes = nodes.unionByName(node(o, tag("o", "o_orderkey"), F.concat_ws(" ", "o_orderpriority", "o_orderkey"), "entity", F.col("o_orderstatus")))
    edge = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    edges = edge(n, tag("r", "n_regionkey"), tag("n", "n_nationkey")).unionByName(edge(c, tag("n", "c_nationkey"), tag("c", "c_custkey"))).unionByName(edge(o, tag("c", "o_custkey"), tag("o", "o_orderkey")))
    return graph.mind_map_filter(nodes, edges, " Urgent ", ["P"])[0].select("id")


@query(f"WITH {MESSAGES_SQL} SELECT conv_id, seq, role FROM msgs WHERE seq > 1 AND seq <= 3")
def messages_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages_between(adapt.messages(spark, sf_dir), 1, 3).select("conv_id", "seq", "role")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), c AS (SELECT user_id, max(ms) AS last_ms FROM e WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id AS id, coalesce(last_ms >= ms - 30000, false) AS cancelled FROM e LEFT JOIN c USING (user_id) WHERE event_type = 'click'""")
def cancelled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as requests of their user, errors as cancellations."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("request_id"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    asked = e.filter("event_type = 'click'").select("request_id", F.col("ms").alias("started_at"), F.col("event_id").alias("id"))
    cancels = e.filter("event_type = 'error'").select("request_id", F.col("ms").alias("at"))
    return run_control.cancelled_requests(asked, cancels, keep=("id",)).select("id", "cancelled")


#: A graph over the star tables: suppliers and parts are nodes, line items of a supplier and a part are edges.
STAR_SQL = """nodes AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name FROM part),
edges AS (SELECT DISTINCT 's' || l_suppkey || 'p' || l_partkey AS id, 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'sells' AS label FROM lineitem),
evidence AS (SELECT 'n' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || l_quantity AS id, l_orderkey AS chunk_id, o_custkey AS document_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey END AS node_id, CASE WHEN l_linenumber % 2 = 1 THEN 's' || l_suppkey || 'p' || l_partkey END AS edge_id, l_shipdate::VARCHAR AS q, l_discount AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {STAR_SQL} SELECT e.id, 'c' || c_custkey AS file_name, CAST(o_orderkey % 100 AS INT) AS chunk_index, l_returnflag_q AS quote, e.confidence, n.name AS node_name, g.label, a.name AS source_name, b.name AS target_name
FROM (SELECT *, 'q' || chunk_id AS l_returnflag_q FROM evidence) e JOIN orders o ON o.o_orderkey = e.chunk_id JOIN customer c ON c.c_custkey = e.document_id
LEFT JOIN nodes n ON n.id = e.node_id LEFT JOIN edges g ON g.id = e.edge_id LEFT JOIN nodes a ON a.id = g.source LEFT JOIN nodes b ON b.id = g.target""")
def evidence_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven-way star of evidence, over all line items."""
    li = table(spark, sf_dir, "lineitem")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(tag("p", "p_partkey").alias("id"), F.col("p_name").alias("name")))
    edge_id = F.concat(tag("s", "l_suppkey"), tag("p", "l_partkey"))
    edges = li.select(edge_id.alias("id"), tag("s", "l_suppkey").alias("source"), tag("p", "l_partkey").alias("target"), F.lit("sells").alias("label")).distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    odd = F.col("l_linenumber") % 2 == 1
    evidence = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("_", tag("n", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"), F.col("l_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"),
        F.when(~odd, tag("p", "l_partkey")).alias("node_id"), F.when(odd, edge_id).alias("edge_id"), tag("q", "l_orderkey").alias("quote"), F.col("l_discount").alias("confidence"),
    )
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 100).cast("int").alias("chunk_index"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), tag("c", "c_custkey").alias("file_name"))
    return graph.evidence_star(evidence, chunks, docs, nodes, edges)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS label, p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE p_retailprice END AS confidence FROM part")
def view_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    stored = p.select(i.alias("id"), F.when(i % 2 == 0, F.col("p_name")).otherwise("").alias("label"), F.lit(None).cast("string").alias("description"), F.when(i % 3 == 0, 0.5).alias("confidence"))
    return graph.enrich_view(stored, p.select(i.alias("id"), F.col("p_brand").alias("label"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("confidence")))


@query("""SELECT t AS scope_type, i AS scope_id, CASE WHEN t = 'ALL' THEN 'ALL' ELSE coalesce(n_name, '(deleted)') END AS name
FROM (SELECT DISTINCT CASE WHEN c_nationkey % 5 = 0 THEN 'ALL' ELSE 'FOLDER' END AS t, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS i FROM customer) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 7 <> 1) ON i = n_nationkey""")
def scope_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    scopes = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, "ALL").otherwise("FOLDER").alias("scope_type"), F.when(k % 5 != 0, k).alias("scope_id")).distinct()
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 1").select(F.lit("FOLDER").alias("scope_type"), F.col("n_nationkey").alias("scope_id"), F.col("n_name").alias("name"))
    return graph.scope_names(scopes, names)


@query(f"""WITH {RUNS_SQL}, last AS (SELECT scope_type, scope_id, max_by(status, (created_at, run_id)) AS status, count(*) AS runs FROM runs GROUP BY ALL),
n AS (SELECT scope_type, scope_id, count(*) AS nodes FROM runs WHERE run_id % 3 = 0 GROUP BY ALL), e AS (SELECT scope_type, scope_id, count(*) AS edges FROM runs WHERE run_id % 4 = 0 GROUP BY ALL),
v AS (SELECT scope_type, scope_id, max(created_at) AS g FROM runs WHERE run_id % 50 = 0 GROUP BY ALL)
SELECT l.*, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, g AS generated_at FROM last l
LEFT JOIN n ON l.scope_type = n.scope_type AND l.scope_id IS NOT DISTINCT FROM n.scope_id LEFT JOIN e ON l.scope_type = e.scope_type AND l.scope_id IS NOT DISTINCT FROM e.scope_id
LEFT JOIN v ON l.scope_type = v.scope_type AND l.scope_id IS NOT DISTINCT FROM v.scope_id""")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapt.runs(spark, sf_dir)
    return graph.graph_status(r, r.filter("run_id % 3 = 0"), r.filter("run_id % 4 = 0"), r.filter("run_id % 50 = 0").withColumn("updated_at", F.col("created_at")))


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT *, max(CASE WHEN role = 'USER' AND seq % 3 = 0 THEN seq END) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM msgs)
SELECT a.conv_id, a.seq, CASE WHEN b.text IS NULL THEN q ELSE substring(substring({collapse_sql('b.text')}, 1, CAST(greatest(0, 800 - length(q) - 1) AS BIGINT)) || ' ' || q, 1, 800) END AS query
FROM (SELECT *, {collapse_sql('text')} AS q FROM t WHERE role = 'USER') a LEFT JOIN msgs b ON a.conv_id = b.conv_id AND a.p = b.seq""")
def fallback_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question after the latest earlier topic (here: every third message)."""
    w = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    topic = F.last(F.when((F.col("role") == "USER") & (F.col("seq") % 3 == 0), F.col("text")), ignorenulls=True).over(w)
    rows = adapt.messages(spark, sf_dir).withColumn("topic", topic).filter("role = 'USER'")
    return rows.select("conv_id", "seq", chat.fallback_query(F.col("topic"), F.col("text")).alias("query"))


@query(f"WITH {MESSAGES_SQL} SELECT conv_id, seq, CASE WHEN role = 'ASSISTANT' AND seq % 4 = 0 THEN 'BACKGROUND' ELSE role END AS role FROM msgs")
def mode_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.messages(spark, sf_dir).withColumn("agent", F.when(F.col("seq") % 4 == 0, "GENERAL_CHAT").otherwise("KNOWLEDGE_BASE"))
    return chat.isolated(rows, "KNOWLEDGE_BASE").select("conv_id", "seq", "role")


@query("""WITH e AS (SELECT user_id AS stream_id, event_id AS n, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'tool' END ELSE 'delta' END AS event, CASE WHEN event_type = 'view' THEN ' ' ELSE props END AS data FROM events),
ends AS (SELECT stream_id, min(n) AS e FROM e WHERE event IN ('done', 'error') GROUP BY stream_id)
SELECT stream_id, string_agg(data, '' ORDER BY n) FILTER (WHERE event = 'delta') AS text, coalesce(upper(max(event) FILTER (WHERE event IN ('done', 'error'))), 'STOPPED') AS status
FROM e LEFT JOIN ends USING (stream_id) WHERE ends.e IS NULL OR n <= ends.e GROUP BY stream_id HAVING trim(coalesce(string_agg(data, '' ORDER BY n) FILTER (WHERE event = 'delta'), '')) <> ''""")
def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "error", "error").when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "done").otherwise("tool")).otherwise("delta")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("n"), event.alias("event"), F.when(kind == "view", " ").otherwise(F.col("props")).alias("data"))
    return chat.stored_answers(e)


@query("SELECT doc_id AS chunk_id, text IS NOT NULL AS found FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose stored extraction can be used again: same content, prompt, model, and no failure."""
    i = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), T.content_hash("text").alias("content_hash"))
    stored = table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), F.when(i % 3 == 0, "old").otherwise(T.content_hash("text")).alias("content_hash"), F.when(i % 5 == 0, "v1").otherwise("v2").alias("prompt_version"),
        F.lit(None).cast("string").alias("model_config_id"), F.when(i % 7 == 0, "FAILED").otherwise("EXTRACTED").alias("status"), F.lit("{}").alias("extraction_json"),
    )
    return graph.cached(chunks, stored, "v2", None).select("chunk_id", F.lit(True).alias("found"))
