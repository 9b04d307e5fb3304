"""Events of running captures: subscriptions on what streams report, and their progress as a table.

``observed`` lets a stream count while it runs: frames, detected frames, pages and the mean quality of each micro-batch come with the
stream's own progress reports, without a job or a pass of their own. ``EventBus`` listens to these reports and passes on

- ``state``: ``active`` when a stream starts, ``idle`` while it waits and when it has ended, ``error`` when it broke off;
- ``progress``: batch, frames so far, and per cent of ``total`` where that is known;
- ``page``: how many pages a batch brought; ``quality``: its mean; ``error``: what broke a stream off.

A callback that raises does not keep the others from being called. With a path, every report is also written as a small file named by run and batch,
so a report that comes twice overwrites itself; ``progress_rows`` reads them as a table.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from foliant.operators.evaluate import progress
from foliant.sources.shared import hadoop

EVENTS = ("state", "page", "quality", "progress", "error")
METRICS = "capture"
REPORT = "run string, query string, batch long, frames long, detected long, pages long, quality double"


def observed(frames: DataFrame, detected: Column | None = None, page: Column | None = None, quality: Column | None = None) -> DataFrame:
    """frames, unchanged, whose stream reports its counts. ``detected`` and ``page`` are conditions, ``quality`` a number."""
    n = lambda c: F.count(F.when(c, 1)) if c is not None else F.lit(0).cast("long") + F.count(F.when(F.lit(False), 1))
    mean = F.avg(quality.cast("double")) if quality is not None else F.max(F.lit(None).cast("double"))
    return frames.observe(METRICS, F.count(F.lit(1)).alias("frames"), n(detected).alias("detected"), n(page).alias("pages"), mean.alias("quality"))


class EventBus(StreamingQueryListener):
    """Add it with ``start`` and take it away with ``stop``. ``name``: only streams of that name."""

    def __init__(self, spark: SparkSession, name: str | None = None, total: int | None = None, path: str | None = None) -> None:
        self.session, self.only, self.total, self.path = spark, name, total, path
        self.lock = threading.Lock()
        self.callbacks: dict[str, dict[str, Callable[[Any], None]]] = {e: {} for e in EVENTS}
        self.runs: dict[str, str | None] = {}
        self.done: dict[str, dict[int, int]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.failures: list[Exception] = []

    # -- subscriptions --

    def on(self, event: str, callback: Callable[[Any], None]) -> Callable[[], None]:
        """Calls ``callback`` with every such event until the returned function is called."""
        if event not in EVENTS:
            raise ValueError(f"events are {', '.join(EVENTS)}, not {event}")
        key = uuid.uuid4().hex
        with self.lock:
            self.callbacks[event][key] = callback

        def unsubscribe() -> None:
            with self.lock:
                self.callbacks[event].pop(key, None)

        return unsubscribe

    def emit(self, event: str, payload: Any) -> None:
        with self.lock:
            held = list(self.callbacks[event].values())
        for callback in held:
            try:
                callback(payload)
            except Exception as e:  # of the caller's code: kept, and the other callbacks go on
                self.failures.append(e)

    def start(self) -> EventBus:
        self.session.streams.addListener(self)
        return self

    def stop(self) -> None:
        self.session.streams.removeListener(self)

    def wait(self, run: str, seconds: float = 30.0) -> bool:
        """Whether the end of a run has been reported in that time; reports come after the stream itself has ended."""
        with self.lock:
            ended = self.ended.setdefault(run, threading.Event())
        return ended.wait(seconds)

    # -- reports --

    def onQueryStarted(self, event) -> None:
        if self.only is None or event.name == self.only:
            self.runs[str(event.runId)] = event.name
            self.emit("state", "active")

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        if run not in self.runs:
            return
        row = p.observedMetrics.get(METRICS)
        seen = {k: row[k] for k in ("frames", "detected", "pages", "quality")} if row is not None else {"frames": p.numInputRows, "detected": 0, "pages": 0, "quality": None}
        self.done.setdefault(run, {})[p.batchId] = seen["frames"]
        done = sum(self.done[run].values())
        if self.path:
            self.put(run, p.batchId, {"run": run, "query": self.runs[run], "batch": p.batchId} | seen)
        self.emit("progress", {"batch": p.batchId, "done": done, "percent": int(done / self.total * 100 + 0.5) if self.total else None})
        if seen["pages"]:
            self.emit("page", {"batch": p.batchId, "pages": seen["pages"]})
        if seen["quality"] is not None:
            self.emit("quality", seen["quality"])

    def onQueryIdle(self, event) -> None:
        if str(event.runId) in self.runs:
            self.emit("state", "idle")

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.runs:
            if event.exception:
                self.emit("error", event.exception)
            self.emit("state", "error" if event.exception else "idle")
        with self.lock:
            self.ended.setdefault(run, threading.Event()).set()

    def put(self, run: str, batch: int, report: dict) -> None:
        p, fs = hadoop(self.session, f"{self.path.rstrip('/')}/{run}-{batch}.json")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps(report).encode() + b"\n"))
        stream.close()


def progress_rows(spark: SparkSession, path: str, total: int | None = None) -> DataFrame:
    """The reports of all runs, with done (frames up to the batch, over the runs of one checkpoint in order of batches) and percent."""
    reports = spark.read.schema(REPORT).json(path)
    done = F.sum("frames").over(W.partitionBy("query").orderBy("batch"))
    rows = reports.withColumn("done", done)
    return rows.withColumn("percent", progress(F.col("done"), F.lit(total if total else 0).cast("double")) if total else F.lit(None).cast("long"))
