"""Cancellations of requests as keyed state: what comes early is kept for a while, by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens.streaming.runs import PENDING_MS

#: Milliseconds for which a request can be cancelled after its start.
OPEN_MS = 3_600_000
#: What a session's state store has to be.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "request_id long, id long, started_at long, cancelled boolean"


class Cancellations(StatefulProcessor):
    """State of a request id: the latest cancel that may still meet a request, and the requests that it may still meet."""

    def __init__(self, pending: int = PENDING_MS, keep_open: int = OPEN_MS):
        self._pending, self._keep_open = pending, keep_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._cancel = handle.getValueState("cancel", "at long")
        self._requests = handle.getMapState("requests", "id long", "started_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for r in part.sort_values("at").itertuples():
                if r.kind == "cancel":
                    at = max(int(r.at), self._cancel.get()[0]) if self._cancel.exists() else int(r.at)
                    self._cancel.update((at,))
                    self._handle.registerTimer(at + self._pending)
                    met = [(k[0], v[0]) for k, v in self._requests.iterator() if at >= v[0] - self._pending]
                    for i, started in met:
                        self._requests.removeKey((i,))
                        out.append((key[0], i, started, True))
                elif self._cancel.exists() and self._cancel.get()[0] >= r.at - self._pending:
                    out.append((key[0], int(r.id), int(r.at), True))
                else:
                    self._requests.updateValue((int(r.id),), (int(r.at),))
                    self._handle.registerTimer(int(r.at) + self._keep_open)
                    out.append((key[0], int(r.id), int(r.at), False))
        yield pd.DataFrame(out, columns=["request_id", "id", "started_at", "cancelled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self._cancel.exists() and self._cancel.get()[0] + self._pending <= now:
            self._cancel.clear()
        for i in [k[0] for k, v in self._requests.iterator() if v[0] + self._keep_open <= now]:
            self._requests.removeKey((i,))
        yield pd.DataFrame([], columns=["request_id", "id", "started_at", "cancelled"])

    def close(self) -> None:
        pass


def cancellations(requests: DataFrame, cancels: DataFrame, late: str = "1 minute", pending: int = PENDING_MS, keep_open: int = OPEN_MS) -> DataFrame:
    """(request_id, id, started_at, cancelled) of two streams: a row when a request comes, and another one if it is cancelled later.

    ``requests``: request_id, id, started_at; ``cancels``: request_id, at (both times in epoch milliseconds).  A request
    is cancelled by a cancel after its start, or within ``pending`` before it; a cancel is forgotten by then, a
    request after ``keep_open``, both by the watermark, which waits ``late`` for rows that come late.  The session
    needs the state store of ``STORE``; the output mode is update.
    """
    asked = requests.select("request_id", "id", F.col("started_at").alias("at"), F.lit("request").alias("kind"))
    told = cancels.select("request_id", F.lit(None).cast("long").alias("id"), "at", F.lit("cancel").alias("kind"))
    rows = asked.unionByName(told).withColumn("_t", F.timestamp_millis("at")).withWatermark("_t", late)
    return rows.groupBy("request_id").transformWithStateInPandas(Cancellations(pending, keep_open), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
