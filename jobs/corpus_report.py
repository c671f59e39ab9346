"""Write a report of every document of a corpus, in a partition for each folder.

    python -m jobs.corpus_report --documents PATH --labels PATH --report PATH [--config jobs/corpus_report.json]

For each document: whether it can be searched, its content's hash, how many searchable documents share that content and
which of them is the first, how many chunks it gives and their tokens, and whether its folder holds another version of
it.  The whole report is written anew, or, if ``folders`` are set, only their partitions; a rerun gives the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import chunk, health
from corpuslens.sources import adapt
from jobs.common import main

log = logging.getLogger(__name__)
#: ``folders``: those to write anew, all of them if null; ``files``: files of a folder's partition at most.
DEFAULTS = {"folders": None, "files": 8}


def report(docs: DataFrame) -> DataFrame:
    """A row for each document of the logical model."""
    groups = health.duplicate_groups(docs).select(F.col("hash").alias("_hash"), "copies", "first_id")
    families = health.version_conflicts(docs).select(F.col("family").alias("_family"), F.col("contents").alias("versions"))
    windows = F.coalesce(chunk.windows(T.clean_prose("text")), F.array().cast("array<string>"))
    tokens = F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + T.chunk_tokens(w))
    searchable = F.col("enabled") & (F.col("status") == "PARSED")
    rows = docs.select(
        "doc_id", "folder", "file_name", "status", searchable.alias("searchable"), T.content_hash("text").alias("content_hash"), T.version_family("file_name").alias("_family"), windows.alias("_w"),
    )
    rows = rows.withColumns({"chunks": F.size("_w").cast("long"), "tokens": tokens}).drop("_w")
    # only searchable documents have copies and versions
    rows = rows.join(groups, F.col("searchable") & (F.col("content_hash") == F.col("_hash")), "left")
    rows = rows.join(families, F.col("searchable") & (rows["_family"] == families["_family"]), "left").drop("_family", "_hash")
    return rows.withColumns({"copies": F.when(F.col("searchable"), F.coalesce("copies", F.lit(1))), "versions": F.when(F.col("searchable"), F.coalesce("versions", F.lit(1)))})


def run(spark: SparkSession, documents: str, labels: str, target: str, **settings) -> DataFrame:
    """Write the report of a corpus, and return the whole of it as it stands."""
    s = DEFAULTS | settings
    docs = adapt.modelled(spark.read.parquet(documents), spark.read.parquet(labels))
    # to a version's sign an underscore is a letter
    docs = docs.withColumn("file_name", F.replace("file_name", F.lit("_"), F.lit("-")))
    rows = report(docs)
    if s["folders"] is not None:  # copies and versions are those of the whole corpus
        rows = rows.filter(F.col("folder").isin(s["folders"]))
    slices = F.pmod(F.xxhash64("doc_id"), F.lit(s["files"]))
    rows = rows.repartition("folder", slices)
    mode = "dynamic" if s["folders"] is not None else "static"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("folder").parquet(target)
    out = spark.read.schema(rows.schema).parquet(target)
    counted = out.filter(F.col("folder").isin(s["folders"])) if s["folders"] is not None else out
    log.info("read %d documents of %s and the labels of %s, wrote %d rows to %s", docs.count(), documents, labels, counted.count(), target)
    return out.select(*rows.columns)


if __name__ == "__main__":
    main(run, ("documents", "labels", "report"), DEFAULTS)
