"""Folders switched on and off, and deleted, with what hangs on their documents: index, chunks and graph.

Each operation takes the tables as they are and returns those that it changes; the stored index gets one new segment.
An operation that is run again, with the same segment number, gives the same tables and the same index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import graph, index_store


def _of(documents: DataFrame, folder) -> DataFrame:
    return documents.filter(F.col("folder").eqNullSafe(F.lit(folder)))


def enable(documents: DataFrame, folder, path: str, segment: int, fields: dict[str, str], at: Column, key: str = "doc_id", buckets: int = index_store.BUCKETS) -> DataFrame:
    """Switch a folder on: its parsed documents are indexed again, as of the time ``at``."""
    index_store.write_segment(_of(documents, folder).filter("status = 'PARSED'"), path, segment, fields, key, buckets=buckets)
    own = F.col("folder").eqNullSafe(F.lit(folder))
    done = own & (F.col("status") == "PARSED")
    return documents.withColumns({"enabled": F.when(own, True).otherwise(F.col("enabled")), "indexed_at": F.when(done, at).otherwise(F.col("indexed_at"))})


def disable(documents: DataFrame, folder, path: str, segment: int, fields: dict[str, str], key: str = "doc_id", buckets: int = index_store.BUCKETS) -> DataFrame:
    """Switch a folder off: its documents leave the index; records, chunks and graph stay."""
    index_store.write_segment(_of(documents, folder).withColumn("_gone", F.lit(True)), path, segment, fields, key, gone="_gone", buckets=buckets)
    own = F.col("folder").eqNullSafe(F.lit(folder))
    return documents.withColumns({"enabled": F.when(own, False).otherwise(F.col("enabled")), "indexed_at": F.when(~own, F.col("indexed_at"))})


def delete(tables: dict[str, DataFrame], folder, path: str, segment: int, fields: dict[str, str], key: str = "doc_id", buckets: int = index_store.BUCKETS) -> dict[str, DataFrame]:
    """Delete a folder: ``documents`` and ``chunks`` lose its rows, the index its documents, and the graph what they added.

    Of the graph, ``node_partials`` and ``edge_partials`` with ``nodes`` and ``edges`` are changed, as far as they are given.
    """
    documents = tables["documents"]
    disable(documents, folder, path, segment, fields, key, buckets)
    gone = _of(documents, folder).select(key)
    out = {"documents": documents.filter(~F.col("folder").eqNullSafe(F.lit(folder)))}
    if "chunks" in tables:
        out["chunks"] = tables["chunks"].join(gone, key, "left_anti")
    changed = gone.select(F.col(key).alias("document_id"))
    for name, graph_key, rows_of in (("node", graph.NODE_KEY, graph.nodes_of), ("edge", graph.EDGE_KEY, graph.edges_of)):
        if f"{name}_partials" in tables:
            partials = tables[f"{name}_partials"]
            now = graph.apply_delta(partials, tables[f"{name}s"], partials.limit(0), changed, graph_key, rows_of)
            out[f"{name}_partials"], out[f"{name}s"] = now
    return out
