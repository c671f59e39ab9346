"""Sinks: merge writes, replaced partitions, JSON codecs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_TYPE = "array<struct<chunk_id: string, file_name: string, heading: string, content: string, score: double>>"


def _place(spark: SparkSession, path: str):
    """The file system of a table and its path, after a swap that was cut short has been brought to its end.

    The old table is moved away before the new one, which is complete by then, takes its place; where the table is
    missing, a complete new one (or else the old one) is therefore what should stand there.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for kind in ("new", "old"):
            beside = fs.globStatus(Path(f"{path}.{kind}-*")) or []
            whole = sorted((s.getModificationTime(), s.getPath().toString()) for s in beside if fs.exists(Path(s.getPath(), "_SUCCESS")))
            if whole:
                _move(fs, Path(whole[-1][1]), target)
                break
    return fs, target


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"can't move {source} to {target}")


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a Parquet table by rows that may be derived from it: written beside it first, then swapped in.

    A crash at any step leaves the old or the new table, which :func:`read_or_empty` and the next call find again.
    """
    spark = df.sparkSession
    fs, target = _place(spark, path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = (Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(new.toString())
    if fs.exists(target):
        _move(fs, target, old)
    _move(fs, new, target)
    for kind in ("new", "old"):  # with what earlier crashes left
        for s in fs.globStatus(Path(f"{path}.{kind}-*")) or []:
            fs.delete(s.getPath(), True)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows where it isn't there yet."""
    fs, target = _place(spark, path)
    if fs.exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def replace_buckets(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write a table in buckets of a key's hash; only buckets that ``df`` has are replaced."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def encode_sources(sources: Column) -> Column:
    """JSON of retrieved sources, without their contents."""
    return F.to_json(F.transform(sources, lambda s: s.dropFields("content")))


def decode_sources(text: Column, schema: str = SOURCE_TYPE) -> Column:
    """Sources from JSON; blank and broken texts are empty lists."""
    return F.coalesce(F.filter(F.from_json(F.coalesce(text, F.lit("[]")), schema, {"mode": "PERMISSIVE"}), lambda s: s.isNotNull()), F.array().cast(schema))
