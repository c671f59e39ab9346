"""The stream of cancellations against the batch query, over batches in which cancels come early and late."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.streaming import cancellation, runs


@pytest.fixture
def rocks(spark):
    key = next(iter(cancellation.STORE))
    had = spark.conf.get(key, None)
    spark.conf.set(key, cancellation.STORE[key])
    yield spark
    spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def test_stream_equals_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    asked, told = str(tmp_path / "asked"), str(tmp_path / "told")
    requests, cancels = [], []
    for batch in range(3):
        base = 1_700_000_000_000 + batch * 120_000
        some = [(rng.randrange(40), batch * 1000 + i, base + rng.randrange(90_000)) for i in range(60)]
        gone = [(rng.randrange(40), base + rng.randrange(90_000)) for _ in range(15)]
        requests += some
        cancels += gone
        spark.createDataFrame(some, "request_id long, id long, started_at long").coalesce(1).write.mode("append").parquet(asked)
        spark.createDataFrame(gone, "request_id long, at long").coalesce(1).write.mode("append").parquet(told)
        a = spark.readStream.schema("request_id long, id long, started_at long").parquet(asked)
        b = spark.readStream.schema("request_id long, at long").parquet(told)
        out = cancellation.cancellations(a, b)

        def keep(df, n):
            df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))

        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("id").agg(F.bool_or("cancelled").alias("cancelled"))
    want = runs.cancelled_requests(spark.createDataFrame(requests, "request_id long, id long, started_at long"), spark.createDataFrame(cancels, "request_id long, at long"), keep=("id",))
    got, want = {r.id: r.cancelled for r in got.collect()}, {r.id: r.cancelled for r in want.collect()}
    assert got == want and set(want.values()) == {True, False}
