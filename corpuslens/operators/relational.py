"""Relational building blocks: merges, latest rows, ordered look-ups, dynamic filters, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import written_once

MAX_IDS, PAGE_DEFAULT, PAGE_MAX = 500, 10, 100


def upsert(target: DataFrame, source: DataFrame, key: str, keep: tuple[str, ...] = (), prefer_new: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` merged in by ``key``.

    A matched row takes the source's columns, but keeps its own ``keep`` columns, and its own ``prefer_new``
    columns where the source has null.
    """
    s = source.select(F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in target.columns])
    both = target.withColumn("_old", F.lit(True)).join(s, F.col(key) == F.col(f"_{key}"), "full")

    def pick(c: str) -> Column:
        new, old = F.col(f"_{c}"), F.col(c)
        if c == key:
            return F.coalesce(old, new)
        if c in keep:
            return F.when(F.col("_old"), old).otherwise(new)
        if c in prefer_new:
            return F.coalesce(new, old)
        return F.when(F.col("_in"), new).otherwise(old)

    return both.select(*[pick(c).alias(c) for c in target.columns])


#: The key of each stored table, and the columns that a row which is there already keeps.
UPSERTS = {"folders": ("folder_path", ("id", "created_at")), "extractions": ("chunk_id", ("id", "created_at")), "configs": ("id", ("created_at",)), "settings": ("setting_key", ("created_at",))}


def upsert_stored(name: str, target: DataFrame, source: DataFrame) -> DataFrame:
    """:func:`upsert` by the rule of a stored table."""
    key, keep = UPSERTS[name]
    return upsert(target, source, key, keep=tuple(c for c in keep if c in target.columns))


def defaulted(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows with defaults in place of nulls, for a list of columns."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` and those rows of ``source`` whose key it doesn't have."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced by those in ``new``."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def with_child_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n_children") -> DataFrame:
    """Each parent and how many children it has, 0 included; children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_k", "_n")


def latest_with_ties(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """The latest rows of each scope, null scopes together; ties are all returned."""
    w = Window.partitionBy(*scope).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def latest_single(rows: DataFrame, scope: list[str], *order: str) -> DataFrame:
    """One latest row of each scope, by falling ``order`` columns."""
    w = Window.partitionBy(*scope).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ordered_lookup(rows: DataFrame, ids: list, key: str, most: int = MAX_IDS) -> DataFrame:
    """Rows of the given ids in their order, at most ``most`` ids; ``pos`` counts from 0."""
    spark = rows.sparkSession
    pos = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(ids[:most]) - 1)).alias("pos"), F.array(*map(F.lit, ids[:most])).alias("id")))
    wanted = spark.range(1).select(pos.alias("p")).select("p.pos", F.col("p.id").alias("_id")) if ids else None
    if wanted is None:
        return rows.limit(0).withColumn("pos", F.lit(0))
    return rows.join(F.broadcast(wanted), F.col(key) == F.col("_id")).drop("_id").orderBy("pos")


def same_scope(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given."""
    return reduce(lambda x, y: x & y, [c for c in conditions if c is not None], F.lit(True))


def keyword_filter(keyword: str | None, *columns: str) -> Column | None:
    """Whether any column contains the trimmed keyword, whatever its case; None for a blank keyword."""
    k = (keyword or "").strip().lower()
    if not k:
        return None
    return reduce(lambda x, y: x | y, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(k)) for c in columns])


def page(rows: DataFrame, number: int | None, size: int | None, *order: Column, default: int = PAGE_DEFAULT) -> DataFrame:
    """One page of ordered rows: pages count from 1, sizes are cut to 1..100."""
    size = max(1, min(PAGE_MAX, default if size is None else size))
    number = max(1, number or 1)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def effective_time() -> Column:
    return F.coalesce("completed_at", "started_at", "queued_at", "created_at")


def duration() -> Column:
    return F.when(F.col("started_at").isNull() | F.col("completed_at").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("completed_at") - F.col("started_at"))).cast("long")


def queue_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Places in the queue from 1, first come first served: places inside ranges of the order, after the ranges before."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    ranged = written_once(rows.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    earlier = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    return ranged.join(F.broadcast(before), "_range").withColumn("position", place.cast("int")).drop("_range", "_before")


def next_sequence(log: DataFrame, new: DataFrame, key: str, seq: str, *order: str) -> DataFrame:
    """``new`` rows with sequence numbers that go on from each key's largest in ``log``."""
    base = log.groupBy(key).agg(F.max(seq).alias("_base"))
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(base, key, "left").withColumn(seq, F.coalesce("_base", F.lit(0)) + F.row_number().over(w)).drop("_base")


def every_flag(rows: DataFrame, key: list[str], flag: Column, name: str = "all") -> DataFrame:
    """Whether all rows of a key have the flag."""
    return rows.groupBy(*key).agg(F.bool_and(flag).alias(name))


def fuzzy_terms(haystack: Column, query: str) -> Column:
    """Every word of the query is part of the haystack, or its letters come in that order."""
    tests = [F.contains(F.lower(haystack), F.lit(t)) | F.lower(haystack).rlike(".*".join(f"\\Q{c}\\E" for c in t)) for t in query.lower().split()]
    return reduce(lambda x, y: x & y, tests, F.lit(True))
