"""The driver's tables as the logical model: folders, documents, runs and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch milliseconds that made-up times count from.
EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder_enabled(source: str | Column = "source") -> Column:
    """Every fourth folder is switched off."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 4 != 3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, folder, file_name, text, status, indexed_at, updated_at, enabled.

    A quality label of 0 stands for a failed parse, 1 for an indexed document, none for one not indexed yet.
    """
    return modelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def modelled(d: DataFrame, labels: DataFrame) -> DataFrame:
    """The same of tables of documents and of labels."""
    lab = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", F.col("source").alias("folder"), F.concat("source", F.lit("_v"), (F.col("doc_id") % 3).cast("string"), F.lit("_"), "lang", F.lit(".md")).alias("file_name"),
        "lang", "text", F.when(F.col("quality") == 0, "FAILED").otherwise("PARSED").alias("status"),
        F.when(F.col("quality") == 1, F.lit(EPOCH) + F.col("doc_id") * 1000).alias("indexed_at"), (F.lit(EPOCH) + F.col("doc_id") * 997).alias("updated_at"),
        folder_enabled().alias("enabled"),
    )


DOCUMENTS_SQL = f"""docs AS (
  SELECT d.doc_id, d.source AS folder, d.source || '_v' || (d.doc_id % 3) || '_' || d.lang || '.md' AS file_name, d.lang, d.text,
    CASE WHEN l.quality = 0 THEN 'FAILED' ELSE 'PARSED' END AS status,
    CASE WHEN l.quality = 1 THEN {EPOCH} + d.doc_id * 1000 END AS indexed_at, {EPOCH} + d.doc_id * 997 AS updated_at,
    coalesce(TRY_CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INT), 0) % 4 <> 3 AS enabled
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance runs: an event is a run of its user's scope; the first user stands for the scope without an id."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("user_id").alias("first"))
    created = F.unix_millis(F.col("ts").cast("timestamp"))
    none = F.col("user_id") == F.col("first")
    return e.join(F.broadcast(first)).select(
        F.col("event_id").alias("run_id"), F.when(none, "ALL").otherwise("KNOWLEDGE_FOLDER").alias("scope_type"), F.when(~none, F.col("user_id")).alias("scope_id"),
        F.col("event_type").alias("status"), created.alias("created_at"),
        F.when(F.col("event_id") % 5 != 0, created + 10).alias("queued_at"), F.when(F.col("event_id") % 3 != 0, created + 100).alias("started_at"),
        F.when(F.col("event_id") % 2 != 0, created + 100 + F.floor(F.abs("value") * 10) - 50).alias("completed_at"), F.col("props").alias("current_item"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS run_id, CASE WHEN none THEN 'ALL' ELSE 'KNOWLEDGE_FOLDER' END AS scope_type, CASE WHEN NOT none THEN user_id END AS scope_id,
    event_type AS status, c AS created_at, CASE WHEN event_id % 5 <> 0 THEN c + 10 END AS queued_at, CASE WHEN event_id % 3 <> 0 THEN c + 100 END AS started_at,
    CASE WHEN event_id % 2 <> 0 THEN c + 100 + CAST(floor(abs(value) * 10) AS BIGINT) - 50 END AS completed_at, props AS current_item
  FROM (SELECT *, epoch_us(ts) // 1000 AS c, user_id = (SELECT min(user_id) FROM events) AS none FROM events)
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: conv_id, sequence from 1, role in capitals, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("seq"), F.upper("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


MESSAGES_SQL = "msgs AS (SELECT conv_id, turn + 1 AS seq, upper(role) AS role, coalesce(text, '') AS text FROM conversations)"
