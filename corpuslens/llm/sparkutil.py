"""Shared tables, size-checked broadcasts and bounded labelled samples."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.session import ship

#: Rows, and bytes of their files, that may be broadcast once they are known; beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Bytes of text that the labelled sample of one class holds.
SAMPLE_BYTES = 16 << 20
_written: list[tuple[SparkSession, str]] = []
#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; only a session on one machine may name none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="corpuslens-checkpoint-")
    return found.rstrip("/")


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(lambda: _delete(_written))


def table(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The table is deleted when the driver's Python ends, or, if it isn't ``lasting``, at the end of a :func:`scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-{name}-{uuid.uuid4().hex}"
    (_written if not lasting else _lasting).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_lasting: list[tuple[SparkSession, str]] = []
atexit.register(lambda: _delete(_lasting))


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables written inside, but for lasting ones: for a step whose result is written before the end."""
    n = len(_written)
    try:
        yield
    finally:
        _delete(_written[n:])
        del _written[n:]


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` (a written table) is within both bounds; else leave the join to shuffle."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, and let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_crc(doc_id="doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def unit_hash(*cols, salt: str):
    """A fixed number from 0 up to 1 for each row."""
    return F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, most: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, float]]:
    """Texts of a bounded, fixed sample of labelled rows: (text, label, fold), a written table, and each class's weight.

    At most ``per_class`` ids of each class, and so many that their texts hold at most ``most`` bytes; ids come in the
    order of a hash.  Rows whose crc32(doc_id) mod ``modulus`` is ``held`` are never read; labels other than 0 and 1,
    and null ids, aren't used; of contradicting labels of one id the larger one counts; of rows that share an id the
    smallest text is taken.  ``fold`` is 0 to 4.
    """
    lab = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).filter(id_crc() % modulus != held)
    lab = lab.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}  # two rows
    order = unit_hash("doc_id", salt="sample")
    chosen = None
    for k, n in counts.items():
        own = lab.filter(F.col("label") == k)
        # the hash keeps a few more than are wanted, which are then cut
        own = own.filter(order < min(1.0, (1.2 * per_class + 100) / n)).orderBy(order, "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        chosen = lab.limit(0)
    chosen = F.broadcast(table(chosen.select(F.col("doc_id").alias("_id"), "label"), "sample-ids"))  # per_class bounds it
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    room = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("label").orderBy(order, "doc_id"))
    out = rows.withColumn("_room", room).filter(F.col("_room") <= most)
    out = table(out.select("text", "label", F.floor(unit_hash("doc_id", salt="fold") * 5).cast("int").alias("fold")), "sample")
    took = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    return out, {k: n / took.get(k, n) for k, n in counts.items()}
