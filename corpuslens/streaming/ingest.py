"""Incremental ingest: a file stream whose batches are classified against the records and merged into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators import health, relational
from corpuslens.session import few, written_once
from corpuslens.sources import files, sinks

RECORD = "id string, path string, file_name string, size bigint, modified bigint, hash string, status string, indexed_at bigint, error string"
RECORD_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
#: What the record of a file says that isn't there any more; key buckets of the table of records.
GONE, BUCKETS = "GONE", 64


def file_stream(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A stream of the files of a folder, as they come."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def ingest_batch(scanned: DataFrame, records: DataFrame, keep_failed: bool = True) -> DataFrame:
    """The records after a batch: new and changed files are parsed, others left.

    With ``keep_failed`` a file that can't be parsed leaves its old record (a sync), else a failed one (an import).
    """
    changes = health.classify_changes(scanned.select(F.col("document_id").alias("id"), "size", "modified", "hash"), records)
    todo = scanned.join(changes.filter(F.col("change").isin("new", "changed")).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    parsed = files.parse(todo).select(
        F.col("document_id").alias("id"), "path", "file_name", "size", "modified", "hash", F.when(F.col("error").isNull(), "PARSED").otherwise("FAILED").alias("status"),
        F.lit(None).cast("bigint").alias("indexed_at"), "error",
    )
    if keep_failed:
        parsed = parsed.join(records.select("id", F.lit(True).alias("_had")), "id", "left").filter((F.col("status") == "PARSED") | F.col("_had").isNull()).drop("_had")
    return relational.upsert(records, parsed, "id")


def remove_missing(records: DataFrame, scanned: DataFrame) -> DataFrame:
    """Records without those whose file is gone."""
    return records.join(scanned.select(F.col("document_id").alias("id")), "id", "left_semi")


def known(spark: SparkSession, table: str) -> DataFrame:
    """The records of the files that are there."""
    return sinks.read_or_empty(spark, table, f"{RECORD}, bucket int").drop("bucket").filter(F.col("status") != GONE)


def _put(rows: DataFrame, table: str) -> None:
    """Put records in place of those of the same ids; only the buckets that they fall into are written.

    Records come from files, so a crash while buckets are replaced costs no more than reading those files again.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    rows = written_once(rows.select(*RECORD_COLUMNS, bucket.alias("bucket")))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    if touched:
        old = sinks.read_or_empty(spark, table, f"{RECORD}, bucket int").filter(F.col("bucket").isin(touched)).join(rows.select("id"), "id", "left_anti")
        both = old.select(*RECORD_COLUMNS, "bucket").unionByName(rows)
        both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def sync(spark: SparkSession, folder: str, table: str, keep_failed: bool = True, recursive: bool = True) -> DataFrame:
    """Bring the table of records to what a folder holds now, and return what was done: (id, path, change).

    The listing (path, size, time) is compared with the records; contents are read only of files that are new or
    differ, or that could not be parsed.  Files that have gone leave a record that says so.  A rerun does nothing more.
    """
    there = files.scan(spark, folder, recursive, content=False).select("document_id", "path", "size", "modified")
    had = known(spark, table).select("id", F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), "status")
    both = there.join(had, F.col("document_id") == F.col("id"), "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")) & (F.col("status") == "PARSED")
    change = F.when(F.col("document_id").isNull(), "gone").when(F.col("id").isNull(), "new").when(~same, "changed")
    changes = written_once(both.select(F.coalesce("document_id", "id").alias("id"), F.coalesce("path", "_path").alias("path"), change.alias("change"), "modified").filter("change IS NOT NULL"))
    todo = changes.filter("change <> 'gone'")
    span = todo.agg(F.min("modified").alias("a"), F.max("modified").alias("b")).first()
    done = spark.createDataFrame([], RECORD)
    if span["a"] is not None:
        # the times of what is read are pushed down to the listing; the join drops the others among them
        scanned = files.scan(spark, folder, recursive, between=(span["a"], span["b"])).join(few(todo.select(F.col("id").alias("document_id"))), "document_id", "left_semi")
        done = ingest_batch(scanned, known(spark, table).join(few(todo.select("id")), "id", "left_semi"), keep_failed)
    gone = known(spark, table).join(few(changes.filter("change = 'gone'").select("id")), "id", "left_semi").withColumn("status", F.lit(GONE))
    _put(done.select(*RECORD_COLUMNS).unionByName(gone.select(*RECORD_COLUMNS)), table)
    return changes.select("id", "path", "change")


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, keep_failed: bool = True) -> StreamingQuery:
    """Bring the records to what the folder holds, then go on with files as they come, batch by batch, until none is new.

    A file stream knows files by their paths, so those that were edited or removed are what :func:`sync` is for.
    """
    sync(spark, folder, table, keep_failed)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.sha2("path", 256).alias("document_id"), "path", files.file_name("path").alias("file_name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), "content")
        rows = written_once(rows.withColumn("type", files.file_type("file_name")).filter(F.col("type").isNotNull()))
        own = known(spark, table).join(few(rows.select(F.col("document_id").alias("id"))), "id", "left_semi")
        _put(ingest_batch(rows, own, keep_failed), table)

    return file_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts of an event stream (an extension: the watermark has no counterpart in the run log)."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
