"""Notifications of streams: sinks for rows that are to be told, and a listener of progress."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQueryListener

#: Takes a payload; raises if it was not delivered.
Notifier = Callable[[dict], None]


def command_notifier(arguments: list[str], timeout_s: float = 60.0) -> Notifier:
    """Runs a command with the payload as JSON on its input."""

    def send(payload: dict) -> None:
        subprocess.run(arguments, input=json.dumps(payload, default=str).encode(), check=True, timeout=timeout_s)  # noqa: S603

    return send


def webhook_notifier(url: str, field: str | None = None, timeout_s: float = 60.0) -> Notifier:
    """Posts the payload as JSON; with ``field`` as one text in that field, as chats want it."""

    def send(payload: dict) -> None:
        body = payload if field is None else {field: ", ".join(f"{k}: {v}" for k, v in payload.items() if v is not None)}
        request = urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout_s):  # noqa: S310 - the caller names the place
            pass

    return send


def with_retries(send: Notifier, delays: tuple[float, ...], wait: Callable[[float], None] = time.sleep) -> Notifier:
    """``send`` tried again after each of the delays; raises what the last try raised."""

    def keep_on(payload: dict) -> None:
        for delay in (*delays, None):
            try:
                return send(payload)
            except Exception:
                if delay is None:
                    raise
                wait(delay)
        return None

    return keep_on


def notify_each(send: Notifier) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that tells each row, on the executors; a batch that is repeated is told again, with its number as ``epoch``."""

    def sink(batch: DataFrame, epoch: int) -> None:
        def tell(rows: Iterator[Row]) -> None:
            for row in rows:
                send(row.asDict(recursive=True) | {"epoch": epoch})

        batch.foreachPartition(tell)

    return sink


class ProgressListener(StreamingQueryListener):
    """Hands rows and seconds of each micro-batch, starts and ends of streams to a function."""

    def __init__(self, tell: Callable[[str, dict], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.tell("started", {"name": event.name, "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.tell("progress", {"name": p.name, "epoch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.tell("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.tell("ended", {"id": str(event.id), "error": event.exception})
