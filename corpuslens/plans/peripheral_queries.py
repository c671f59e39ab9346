"""Queries over the smaller transforms, sinks and run control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import urls
from corpuslens.operators import peripheral as P
from corpuslens.plans.registry import query
from corpuslens.plans.text_queries import trim_sql
from corpuslens.sources import adapt, files, sinks
from corpuslens.sources.adapt import RUNS_SQL, table
from corpuslens.streaming import runs as run_control

_URL = "CASE page_id % 4 WHEN 0 THEN url || '/models' WHEN 1 THEN ' ' || url || '//' WHEN 2 THEN url || '?q=1' ELSE url END"
_CLEAN = f"regexp_replace({trim_sql('u')}, '/+$', '')"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(v, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+(/[^?#\\s]*)?$') THEN CASE WHEN ends_with(v, '/models') THEN left(v, length(v) - 7) ELSE v END END AS base
FROM (SELECT page_id, {_CLEAN} AS v FROM (SELECT page_id, {_URL} AS u FROM pages))""")
def base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("page_id") % 4, F.col("url")
    messy = F.when(i == 0, F.concat(u, F.lit("/models"))).when(i == 1, F.concat(F.lit(" "), u, F.lit("//"))).when(i == 2, F.concat(u, F.lit("?q=1"))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", urls.base_url(messy).alias("base"))


@query(f"SELECT DISTINCT 'web:' || substring(sha256(url), 1, 24) AS id, url, {trim_sql('html')} AS title, html || chr(10) || url AS content, CASE WHEN page_id % 3 = 0 THEN 0.0::DOUBLE ELSE page_id / 10.0 END AS score FROM pages WHERE page_id % 7 <> 0")
def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"), F.col("html").alias("title"), F.array("html", "url").alias("highlights"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") / 10.0).alias("score"))
    return P.web_results(rows)


@query("SELECT p_brand || '-' || p_size AS id, min(p_type) AS owner FROM part WHERE p_size % 9 <> 0 GROUP BY 1")
def model_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues of a brand each, as JSON."""
    one = F.struct(F.when(F.col("p_size") % 9 != 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).otherwise(" ").alias("id"), F.col("p_type").alias("owned_by"))
    catalogues = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("json"))
    return P.model_options(catalogues)


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'EMBEDDING' WHEN contains(lower(p_type), 'brass') THEN 'CHAT' WHEN contains(lower(p_name), 'steel') THEN 'EMBEDDING' ELSE 'UNKNOWN' END AS capability FROM part")
def model_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.capability(F.col("p_type"), F.col("p_name"), ["steel"], ["brass"]).alias("capability"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'EMBEDDING' WHEN contains(lower(p_type), 'brass') OR contains(lower(p_brand), '#3') THEN 'CHAT'
  WHEN contains(lower(p_name), 'steel') THEN 'EMBEDDING' ELSE 'UNKNOWN' END AS capability FROM part""")
def nested_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints in strings that lie deep inside an entry's fields; names of fields, numbers and other fields don't count."""
    deep = F.struct(F.array(F.struct(F.col("p_type").alias("kind"), F.lit(1).alias("steel"))).alias("list"), F.struct(F.array(F.array("p_brand")).alias("brass")).alias("inner"))
    entry = F.to_json(F.struct(F.col("p_name").alias("id"), deep.alias("capabilities"), F.lit("steel and brass").alias("note")))
    return table(spark, sf_dir, "part").select("p_partkey", P.json_capability(entry, ["capabilities", "tags"], F.col("p_name"), ["steel"], ["brass", "#3"]).alias("capability"))


@query("""WITH o AS (SELECT p_brand AS owner, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN contains(lower(p_type), 'steel') THEN 'EMBEDDING' WHEN contains(lower(p_type), 'brass') THEN 'CHAT' ELSE 'UNKNOWN' END AS capability FROM part)
SELECT 'EMBEDDING' AS role, *, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE capability WHEN 'EMBEDDING' THEN 0 WHEN 'CHAT' THEN 2 ELSE 1 END, id) AS INT) AS place FROM o
UNION ALL SELECT 'CHAT', *, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE capability WHEN 'CHAT' THEN 0 WHEN 'EMBEDDING' THEN 2 ELSE 1 END, id) AS INT) FROM o""")
def model_options_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's options in the order in which either role is offered them."""
    entry = F.to_json(F.struct(F.struct(F.array("p_type").alias("kinds")).alias("capabilities")))
    options = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").cast("string").alias("id"), P.json_capability(entry, ["capabilities"], F.lit(""), ["steel"], ["brass"]).alias("capability"))
    both = [P.rank_options(options, role, "owner").select(F.lit(role).alias("role"), "owner", "id", "capability", "place") for role in ("EMBEDDING", "CHAT")]
    return both[0].unionByName(both[1])


@query("""WITH n AS (SELECT user_id AS stream_id, event_id AS n, event_type, props FROM events),
framed AS (SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM n)
SELECT stream_id, frame, coalesce(max_by(event_type, n) FILTER (WHERE event_type = 'error'), 'message') AS event, string_agg(props, chr(10) ORDER BY n) FILTER (WHERE event_type NOT IN ('view', 'error')) AS data
FROM framed WHERE event_type <> 'view' GROUP BY stream_id, frame HAVING count(*) FILTER (WHERE event_type <> 'error') > 0""")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as lines of an event stream: views are blank lines, errors name the event."""
    kind = F.col("event_type")
    line = F.when(kind == "view", "").when(kind == "error", "event: error").otherwise(F.concat(F.lit("data: "), F.col("props")))
    return P.frames(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("n"), line.alias("line")))


@query("""WITH l AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 + turn % 2 END AS level FROM conversations),
p AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER w AS l1, max(CASE WHEN level = 2 THEN turn END) OVER w AS l2, max(CASE WHEN level = 3 THEN turn END) OVER w AS l3 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(turn AS INT) AS line, CAST(level AS INT) AS level, CAST(CASE level WHEN 2 THEN l1 WHEN 3 THEN CASE WHEN l1 IS NULL OR l2 > l1 THEN l2 END WHEN 4 THEN CASE WHEN (l1 IS NULL AND l2 IS NULL) OR l3 > greatest(coalesce(l1, -1), coalesce(l2, -1)) THEN l3 END END AS INT) AS parent FROM p""")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Markdown outline, a line for each turn."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3 + F.col("turn") % 2).cast("int")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.repeat(F.lit("#"), level), F.lit(" x")).alias("l")))), lambda x: x["l"])
    text = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("t"))
    return P.outline(text, "conv_id", "t").select("conv_id", "line", "level", "parent")


@query("""SELECT doc_id, CASE WHEN k = 0 THEN 'new ' || doc_id ELSE 'old' END AS query, k = 0 AS rewritten,
  CASE k WHEN 0 THEN 'because' WHEN 1 THEN 'kept' WHEN 2 THEN 'rewritten_query_blank' WHEN 3 THEN 'contextualizer_fields_missing' WHEN 4 THEN 'invalid_json' ELSE 'rewritten_query_too_long' END AS reason, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS confidence
FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)""")
def rewrite_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit('x {"shouldRewrite": true, "rewrittenQuery": " new '), F.col("doc_id").cast("string"), F.lit(' ", "reason": "because", "confidence": 1.7} y')))
        .when(k == 1, '{"shouldRewrite": false, "reason": "kept", "confidence": 0.4}')
        .when(k == 2, '{"shouldRewrite": true, "rewrittenQuery": " ", "reason": "r", "confidence": 0.4}')
        .when(k == 3, '{"shouldRewrite": true, "rewrittenQuery": "q"}')
        .when(k == 4, "no json")
        .otherwise(F.concat(F.lit('{"shouldRewrite": true, "reason": "r", "confidence": 1, "rewrittenQuery": "'), F.repeat(F.lit("long "), F.lit(200)), F.lit('"}')))
    )
    return table(spark, sf_dir, "documents").select("doc_id", P.rewrite_verdict(F.lit("old"), answer).alias("v")).select("doc_id", "v.*")


@query("""WITH i AS (SELECT ['INDEX_INCONSISTENT', 'EMBEDDING_UNCONFIGURED', 'GRAPH_STALE', 'DUPLICATE_DOCUMENT_CONTENT', 'POSSIBLE_VERSION_CONFLICT', 'PARSE_FAILED'][event_id % 6 + 1] AS code, user_id AS scope_id, event_id % 3 AS count, event_id FROM events)
SELECT CASE code WHEN 'INDEX_INCONSISTENT' THEN 'retrieval' WHEN 'EMBEDDING_UNCONFIGURED' THEN 'capability' WHEN 'GRAPH_STALE' THEN 'graph' ELSE 'content-risk' END AS category, count(*) AS issues,
  CAST(sum(CASE WHEN scope_id % 10 = 0 AND code = 'GRAPH_STALE' THEN 0 WHEN count > 0 THEN count ELSE 1 END) AS BIGINT) AS active
FROM i WHERE code <> 'PARSE_FAILED' GROUP BY 1""")
def issue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("INDEX_INCONSISTENT", "EMBEDDING_UNCONFIGURED", "GRAPH_STALE", "DUPLICATE_DOCUMENT_CONTENT", "POSSIBLE_VERSION_CONFLICT", "PARSE_FAILED")))
    e = table(spark, sf_dir, "events")
    issues = e.select(F.get(codes, (F.col("event_id") % 6).cast("int")).alias("code"), F.col("user_id").alias("scope_id"), (F.col("event_id") % 3).alias("count"))
    ignored = e.filter("user_id % 10 = 0").select(F.lit("GRAPH_STALE").alias("code"), F.col("user_id").alias("scope_id")).distinct()
    return P.issue_categories(issues, ignored)


@query(f"""WITH {RUNS_SQL}, s AS (SELECT run_id, CASE status WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status, completed_at FROM runs)
SELECT run_id, CASE status WHEN 'QUEUED' THEN 'CANCELLED' WHEN 'RUNNING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 99 ELSE completed_at END AS completed_at FROM s""")
def run_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_control.repair(_states(spark, sf_dir), F.lit(99).cast("long")).select("run_id", "status", "completed_at")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("status")
    return adapt.runs(spark, sf_dir).withColumn("status", F.when(kind == "view", "QUEUED").when(kind == "click", "RUNNING").when(kind == "error", "FAILED").otherwise("COMPLETED"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT run_id, CASE status WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM runs)
SELECT run_id, CASE WHEN run_id % 2 = 0 AND status = 'RUNNING' THEN 'COMPLETED' ELSE status END AS status FROM s""")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second run is asked to complete; only those that run may."""
    rows = _states(spark, sf_dir)
    wanted = rows.filter("run_id % 2 = 0").select("run_id", F.lit("COMPLETED").alias("to"))
    return run_control.transition(rows, wanted, F.lit(99).cast("long")).select("run_id", "status")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS n, CASE WHEN doc_id % 4 <> 3 THEN lang END AS file_name FROM documents")
def source_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as JSON without contents and read back; every fourth text is broken."""
    d = table(spark, sf_dir, "documents")
    one = F.struct(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("file_name"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content"), F.lit(0.5).alias("score"))
    text = F.when(F.col("doc_id") % 4 == 3, "[{broken").otherwise(sinks.encode_sources(F.array(one)))
    back = d.select("doc_id", sinks.decode_sources(text).alias("s"))
    return back.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0))["file_name"].alias("file_name"))


@query("SELECT o_orderpriority AS role, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus = 'O' DESC, o_totalprice DESC, o_orderkey) = 1 AS active FROM orders")
def promote_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("active"), F.col("o_totalprice").alias("updated_at"))
    return P.promote(o).select("role", "id", "active")


@query("SELECT c_custkey, greatest(1, least(50, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN -c_custkey END, 8))) AS top_k FROM customer")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", P.clamped(F.when(k % 3 == 0, k), F.when(k % 5 == 0, -k), 8, 1, 50).alias("top_k"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'MARKDOWN' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'DOCX' WHEN 3 THEN 'PDF' END AS type FROM pages")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("a/B"), F.get(F.array(*map(F.lit, (".MD", ".txt", ".Docx", ".pdf", ".exe"))), (F.col("page_id") % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", files.file_type(files.file_name(name)).alias("type"))
