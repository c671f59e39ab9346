"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are put in the order (hash of the text, doc_id), in which equal texts lie side by side, and dealt into ranges of
that order; a text's copies can fill many ranges, so none holds a hot group whole.  Running sums inside a range
plus the totals of the ranges before it give each row its place among all bytes; a row goes to the shard in whose
equal part of them its middle lies.  So shards are contiguous, and their bytes differ by about one row at most.
A group of equal texts that a cut would divide goes to one side whole if it is within ``slack`` of a shard's size.

Defined cases: a null text has size 8 and the checksum of the empty text; a null doc_id sorts first; repeated rows
each get a slot, and fill as many ranges as they need; a very long text is a large size and nothing more; an empty table gives an empty result; shards may stay empty if
there are few rows; other columns are ignored (:func:`write_shards` keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import sparkutil

SHARDS = 24
OVERHEAD = 8
#: Share of a shard's size up to which a group of equal texts is kept whole at a cut.
SLACK = 0.01


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def assign(docs: DataFrame, n_shards: int = SHARDS, slack: float = SLACK, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, shard and slot of each row; with ``whole`` the row itself, as ``row_``."""
    n, extra = F.lit(n_shards), ["row_"] * whole
    slim = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), _text_hash().alias("text_hash"),
        F.monotonically_increasing_id().alias("tie"), *[F.struct("*").alias(c) for c in extra],
    )
    order = ["text_hash", F.col("doc_id").asc_nulls_first(), "tie"]
    ranged = slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # written once, because another run of the range sampling could draw other ranges
    rows = sparkutil.table(ranged.withColumns({"run": F.sum("size").over(upto), "number": F.row_number().over(upto)}), "shard-runs")

    # one row for each range from here to "before"
    totals = rows.groupBy("range").agg(F.max("run").alias("bytes"), F.max("number").cast("long").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(
        "range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"),
        F.sum("bytes").over(every).alias("total"),
    )
    end = F.col("base") + F.col("run")
    placed = rows.join(F.broadcast(before), "range").select(  # as many rows as partitions
        "doc_id", "size", "text_crc32", "text_hash", (end - F.col("size")).alias("start"), end.alias("end"), (F.col("row0") + F.col("number") - 1).alias("row"), "total", *extra,
    )
    middle = F.col("start") + F.expr("size div 2")
    placed = placed.withColumn("cut", F.least(F.floor(middle * n / F.col("total")), n - 1).cast("int"))

    # groups that a cut divides: the last text before it is the first after it; one row for each cut
    edges = placed.groupBy("cut").agg(F.min_by("text_hash", "row").alias("head"), F.max_by("text_hash", "row").alias("tail"))
    divided = edges.withColumn("prev", F.lag("tail").over(Window.orderBy("cut"))).filter(F.col("prev") == F.col("head")).select(F.col("head").alias("text_hash")).distinct()
    groups = placed.join(F.broadcast(divided), "text_hash", "left_semi").groupBy("text_hash").agg(
        F.min("start").alias("a"), F.max("end").alias("b"), F.min("cut").alias("low"), F.max("cut").alias("high"), F.max("total").alias("total")
    )
    border = F.col("high") * F.col("total") / n
    whole = groups.filter((F.col("high") == F.col("low") + 1) & (F.col("b") - F.col("a") <= slack * F.col("total") / n)).select(
        "text_hash", F.when(border - F.col("a") < F.col("b") - border, F.col("high")).otherwise(F.col("low")).alias("kept")
    )
    sharded = placed.join(F.broadcast(whole), "text_hash", "left").withColumn("shard", F.coalesce("kept", "cut"))
    first = sharded.groupBy("shard").agg(F.min("row").alias("row0"))  # one row for each shard
    return sharded.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "text_hash", "shard", (F.col("row") - F.col("row0")).alias("slot"), *extra)


def shard_law(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The columns of the contract: the law is ``bytes``."""
    return assign(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> str:
    """Write whole rows as Parquet, one folder ``shard=N`` for each shard; files are in slot order by their names.

    A shard is written by as many tasks as it needs.  If ``docs`` has a column of the folders' name, theirs gets
    underscores before it; the name is returned.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"_{name}")

    shard, slot = free("shard"), free("slot")
    rows = assign(docs, n_shards, whole=True).select(F.col("shard").alias(shard), F.col("slot").alias(slot), "row_.*")
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
    return shard
