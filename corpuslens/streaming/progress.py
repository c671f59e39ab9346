"""Progress of runs and streams as events for a listener."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.streaming.listener import StreamingQueryListener

Send = Callable[[str, dict], None]


@dataclass
class RunProgress:
    """Sends snapshot, started, progress, and one of completed, failed and cancelled; progress every few items or seconds."""

    send: Send
    total: int
    every: int = 10
    seconds: float = 5.0
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    _sent: int = 0
    _at: float = field(default=0.0)

    def start(self) -> None:
        self._at = self.clock()
        self.send("started", {"current": 0, "total": self.total})

    def step(self, item: str | None = None) -> None:
        self.done += 1
        now = self.clock()
        if self.done - self._sent >= self.every or now - self._at >= self.seconds or self.done == self.total:
            self._sent, self._at = self.done, now
            self.send("progress", {"current": self.done, "total": self.total, "item": item})

    def finish(self, error: str | None = None, cancelled: bool = False) -> None:
        self.send("cancelled" if cancelled else "failed" if error else "completed", {"current": self.done, "total": self.total, "error": error})


class StreamProgress(StreamingQueryListener):
    """Forwards the progress of streaming queries as the same events."""

    def __init__(self, send: Send):
        self._send = send

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._send("started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._send("progress", {"id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._send("failed" if event.exception else "completed", {"id": str(event.id), "error": event.exception})
