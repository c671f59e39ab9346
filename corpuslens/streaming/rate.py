"""Rate limits: what a sliding quota shows over a log, and a limiter for calls to injected models."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Out = TypeVar("Out")


def window_usage(rows: DataFrame, key: str, millis: str, cost: str, width: int = 60_000, quota: int = 300_000) -> DataFrame:
    """``window_cost`` of the ``width`` milliseconds up to each request, and whether it is over the quota."""
    w = Window.partitionBy(key).orderBy(millis).rangeBetween(-width, 0)
    return rows.withColumn("window_cost", F.sum(cost).over(w).cast("long")).withColumn("limited", F.col("window_cost") > quota)


class RateLimiter:
    """Requests spaced evenly by their quota, and at most ``tokens`` in any ``width`` seconds."""

    def __init__(self, requests: int = 300, tokens: int = 300_000, width: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.spacing, self.tokens, self.width, self.clock, self.sleep = width / requests, tokens, width, clock, sleep
        self._last: float | None = None
        self._spent: deque[tuple[float, int]] = deque()

    def acquire(self, tokens: int) -> float:
        """Wait until the request may go; returns the time that it waited."""
        began = self.clock()
        while True:
            now = self.clock()
            while self._spent and now - self._spent[0][0] >= self.width:
                self._spent.popleft()
            wait = 0.0 if self._last is None else max(0.0, self._last + self.spacing - now)
            used = sum(n for _, n in self._spent)
            if self._spent and used + tokens > self.tokens:
                wait = max(wait, self._spent[0][0] + self.width - now)
            if wait <= 0:
                self._last = now
                self._spent.append((now, tokens))
                return now - began
            self.sleep(wait)


def with_retries(call: Callable[[], Out], limited: Callable[[Exception], bool], attempts: int = 5, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Out:
    """Call again after a growing pause while the error means that a rate limit was hit."""
    for attempt in range(attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or not limited(e):
                raise
            sleep(min(most, first * 2**attempt) * (1 + 0.1 * jitter()))
    raise AssertionError("unreachable")
