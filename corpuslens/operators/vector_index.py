"""Approximate nearest neighbours: inverted lists of a coarse quantiser, and an exact search over the same lists.

``centers`` are trained by Spark's k-means on a bounded sample of the vectors; every vector then goes to the list of
its nearest center.  An index is two Parquet tables under a path: ``vectors``, in a partition for each list, and
``cells`` with each list's center, its radius (the largest angle to its center) and how many vectors it holds.

A search asks the lists of the nearest ``probes`` centers and ranks what they hold by the exact score; how many that
must be is measured (:func:`probes_for`), since vectors without clusters need far more than clustered ones.  With ``exact``
it then asks, too, every list that may hold something nearer than the k-th found: angles are a metric, so a list can't
if its center is further than that by more than its radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import search
from corpuslens.session import few, written_once

#: Vectors that train the quantiser at most, lists of an index at most, and passes over the sample.
SAMPLE, CELLS, PASSES = 100_000, 1024, 10
#: Share of the lists that a search asks if it isn't told how many; queries that are looked at to tell.
PROBE_SHARE, TRIALS = 0.5, 200
SLACK = 1e-6
#: Pairs of a query and a list, each with the query's vector, that Python holds at once.
PAIRS = 1 << 16


def usable(vectors: DataFrame, *columns: str) -> DataFrame:
    """Rows whose vector has a direction."""
    return vectors.select(*columns, "embedding").filter(F.exists("embedding", lambda v: v != 0))


def train(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centers, about the square root of the number of vectors, at most ``CELLS``, learned from at most about ``sample`` of them."""
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    cells = min(cells or round(n**0.5) or 1, CELLS, n)
    order = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(order < min(1.0, sample / n)).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=PASSES, distanceMeasure="cosine").fit(some)
    centers = np.array(model.clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)


def _unit(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(vectors: DataFrame, path: str, centers: np.ndarray, key: str = "vec_id", files: int = 4) -> None:
    """Write the index of all vectors; null and all-zero vectors are near to nothing, and left out."""
    rows = usable(vectors, key)
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, embedding array<float>, cell int, angle double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch, centers.shape[1]) @ centers.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(angle)], [key, "embedding", "cell", "angle"])

    placed = rows.withColumn("embedding", F.col("embedding").cast("array<float>")).mapInArrow(assign, schema)
    # a list that a third of all vectors share goes to several files
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(files))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    held = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    known.join(held, "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")


def probes_for(spark: SparkSession, path: str, vectors: DataFrame, k: int, recall: float = 0.95, key: str = "vec_id", trials: int = TRIALS) -> int:
    """How many lists have to be asked to find that share of the k nearest: measured against an exact search for about ``trials`` of the vectors."""
    rows = usable(vectors, key)
    order = F.pmod(F.xxhash64(key, F.lit("trial")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(order < min(1.0, trials / max(1, rows.count()))).select(F.col(key).alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    some = written_once(some)
    cells = [r for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect() if r["n"]]  # CELLS at most
    if not cells:
        return 1
    centers, number = np.array([r["center"] for r in cells]), np.array([r["cell"] for r in cells])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of a found vector's list in the order of its query."""
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch, centers.shape[1]) @ centers.T
                own = near[np.arange(len(near)), np.searchsorted(number, batch.column("cell").to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array((near >= own[:, None]).sum(axis=1).astype(np.int32))], ["place"])

    found = written_once(search.vector_topk(rows, some, k, key).select("query_id", key))
    lists = spark.read.parquet(f"{path}/vectors").select(key, "cell")
    places = few(found).join(lists, key).join(few(some), "query_id").select("embedding", "cell").mapInArrow(place, "place int")
    return places.agg(F.percentile("place", F.lit(recall)).alias("p")).select(F.ceil("p").cast("int")).first()[0] or 1


def topk(spark: SparkSession, path: str, query: DataFrame, k: int, key: str = "vec_id", probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, key, score, rank) by (1 + cosine) / 2, as :func:`search.vector_topk` has them; ``query`` is a stated set of vectors."""
    cells = [r for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect() if r["n"]]  # CELLS at most
    ids = query.schema["query_id"].dataType.simpleString()
    if not cells:  # an index of nothing has no type of keys
        return spark.createDataFrame([], f"query_id {ids}, {key} {ids}, score double, rank int")
    lists = spark.read.parquet(f"{path}/vectors").select(key, "embedding", "cell")
    kind = lists.schema[key].dataType.simpleString()
    centers, radius = np.array([r["center"] for r in cells]), np.array([r["radius"] for r in cells])
    number = np.array([r["cell"] for r in cells], np.int32)
    asked = min(len(cells), probes or int(PROBE_SHARE * len(cells) + 0.999))
    query = usable(query, "query_id").withColumn("embedding", F.col("embedding").cast("array<float>"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each query: the nearest ones, or, where a bar is known, the others that can reach it."""
        step = max(1, PAIRS // len(cells))  # every list may be asked by every query
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            near = _unit(batch, centers.shape[1]) @ centers.T
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, np.argpartition(-near, asked - 1, axis=1)[:, :asked], True, axis=1)
            if "bar" in batch.schema.names:
                bar = np.arccos(np.clip(2 * batch.column("bar").to_numpy(zero_copy_only=False).astype(float) - 1, -1, 1))  # no bar: NaN, every list
                first = ~first & ~(np.arccos(np.clip(near, -1, 1)) - radius > bar[:, None] + SLACK)
            q, c = np.nonzero(first)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q)), batch.column("embedding").take(pa.array(q)), pa.array(number[c])], ["query_id", "embedding", "cell"])

    schema = f"query_id {ids}, embedding array<float>, cell int"
    found = _meet(lists, query.mapInArrow(route, schema), k, key, ids, kind)
    best = search.top(found, k, key)
    if not exact:
        return best
    bar = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    more = query.join(bar, "query_id", "left").mapInArrow(route, schema)
    return search.top(best.drop("rank").unionByName(_meet(lists, more, k, key, ids, kind)), k, key)


def _meet(lists: DataFrame, asked: DataFrame, k: int, key: str, ids: str, kind: str) -> DataFrame:
    """Scores of the best rows of each list for the queries that ask it, by blocks of both."""
    cell = F.col("cell")

    def pack(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.take(pa.compute.sort_indices(batch.column("cell"))) if batch.num_rows else batch
                cells = batch.column("cell").to_numpy()
                edges = np.flatnonzero(np.diff(cells, prepend=-1)) if len(cells) else []
                for a, b in zip(edges, [*edges[1:], len(cells)], strict=True):
                    for at in range(a, b, search.BLOCK):
                        part = batch.slice(at, min(search.BLOCK, b - at))
                        flat = part.column("embedding").flatten().cast(pa.float32())
                        cols = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(name), flat)]
                        yield pa.RecordBatch.from_arrays([pa.array([cells[a]], pa.int32()), *cols], ["cell", f"_{name}", f"_{name}_flat"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, flat, queries, wanted = (batch.column(c)[i].values for c in (f"_{key}", f"_{key}_flat", "_query_id", "_query_id_flat"))
                dims = len(flat) // len(keys)
                score = (1 + search._unit_rows(wanted.to_numpy(), dims) @ search._unit_rows(flat.to_numpy(), dims).T) / 2
                if k < len(keys):  # what may tie with the k-th stays
                    q, v = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] - 2e-9)
                else:
                    q, v = np.indices(score.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), keys.take(pa.array(v)), pa.array(score[q, v])], ["query_id", key, "score"])

    rows = lists.mapInArrow(pack(key), f"cell int, _{key} array<{kind}>, _{key}_flat array<float>")
    # queries of a list lie together, those of one that very many ask in several partitions
    near = asked.repartition(cell, F.pmod(F.xxhash64("query_id"), F.lit(4))).mapInArrow(pack("query_id"), f"cell int, _query_id array<{ids}>, _query_id_flat array<float>")
    pairs = rows.join(near, "cell").drop("cell")
    return pairs.mapInArrow(meet, f"query_id {ids}, {key} {kind}, score double")
