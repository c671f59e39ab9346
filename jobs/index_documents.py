"""Keep a keyword index of a documents table up to date, taking only files that are new.

    python -m jobs.index_documents --documents PATH --index PATH --checkpoint PATH [--config jobs/index_documents.json]

The table's files are read as a stream that ends when there is nothing new; each batch becomes one segment of the index
(:mod:`corpuslens.operators.index_store`), written under the batch's number.  A batch that is run again, after a crash
at any place, writes the same segment again; a run without new files writes nothing.  A document that comes again
replaces its older form, and one that comes with a null text is deleted.  Index and checkpoint belong together.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import index_store
from corpuslens.session import few
from jobs.common import main

log = logging.getLogger(__name__)
#: ``key`` and ``fields`` (field name to text column) of the table; ``files``: how many files a batch takes at most.
DEFAULTS = {"key": "doc_id", "fields": {"content": "text"}, "files": 1000, "buckets": index_store.BUCKETS}


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, **settings) -> DataFrame:
    """Add the new files of a documents table to its index, and return the index's postings as they stand.

    Rows without a key are left out; of several rows of a key in one batch the one of the greatest texts counts.
    """
    s = DEFAULTS | settings
    key, fields = s["key"], s["fields"]
    columns = list(dict.fromkeys(fields.values()))
    table = spark.read.parquet(documents)
    source = documents.rstrip("/")
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [source.rsplit("/", 1)[-1]]:
        source = f"{source[:-1]}[{source[-1]}]"  # a stream takes a folder, or a pattern, which one file is here
    stream = spark.readStream.schema(table.select(key, *columns).schema).option("maxFilesPerTrigger", s["files"]).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(key).isNotNull()).select(key, *columns)
        again = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
        if not again.isEmpty():  # only keys that come more than once have their texts shuffled
            again = few(again)
            most = rows.join(again, key, "left_semi").groupBy(key).agg(F.max(F.struct(*columns)).alias("_row")).select(key, "_row.*")
            rows = rows.join(again, key, "left_anti").unionByName(most)
        rows = rows.withColumn("_gone", F.coalesce(*columns).isNull())
        index_store.write_segment(rows, index, number, fields, key, gone="_gone", buckets=s["buckets"])
        wrote = index_store.wrote(spark, index, number)
        log.info("batch %d: read %d rows of %s, wrote %d documents and %d postings to %s", number, batch.count(), documents, *wrote, index)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: nothing new is left in %s", index, documents)
    return index_store.live_postings(spark, index, key)


if __name__ == "__main__":
    main(run, ("documents", "index", "checkpoint"), DEFAULTS)
