"""Capture sessions over streams: throttle and leader dedup in one stateful operator, by ``transformWithState``.

State of a session, each part in the store that fits it:

- a value: when the last frame was taken, how many pages there are, and the timer that is set;
- a list: id and hash of each kept page. A new page is appended; what is there is read but never written again;
- a map from hash to page, so a copy of a kept page is known without a look at the list;
- with event time, a list of frames that wait until the watermark has passed them, to which each micro-batch appends. One timer
  a session stands at the earliest of them; when it goes off all that the watermark has passed are judged in the order of
  (time, id), and what still waits, the frames of the last ``delay``, is listed anew. So the pages don't depend on how frames
  came in, if none is later than ``delay``.

Without ``delay``, frames are judged as they come, those of one micro-batch in order, and ``ttl_ms`` lets state end after that time
without a write to it; such a stream looks after its state in batches without data too, so it is stopped, it does not end by itself. A frame with ``session_start`` begins its session anew; a row with ``remove_id`` takes that page out of the session, so
its like can be kept again. Frames without a hash, time or id are passed over.

Spark keeps such state in RocksDB only; ``use_rocksdb`` says so to a session that has no setting of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.shipping import ship
from foliant.streaming.stateful import CAMERA_LEAD, bits_between

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get(_SETTING, None) or ""):
        spark.conf.set(_SETTING, PROVIDER)


class Capture(StatefulProcessor):
    """The operator. ``id_type``: SQL type of ids; ``ordered``: frames wait for the watermark."""

    def __init__(self, gap: float, threshold: int, id_type: str, ordered: bool, camera: bool, ttl_ms: int | None) -> None:
        self.least, self.threshold, self.id_type = round(gap * 1e6), threshold, id_type
        self.ordered, self.camera, self.ttl_ms = ordered, camera, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "last long, pages int, timer long", self.ttl_ms)
        self.kept = handle.getListState("kept", f"id {self.id_type}, words binary", self.ttl_ms)
        self.seen = handle.getMapState("seen", "words binary", f"id {self.id_type}", self.ttl_ms)
        if self.ordered:
            self.waiting = handle.getListState("waiting", f"at long, id {self.id_type}, words binary, starts boolean, removes {self.id_type}")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        frames = ((r["_at"], r["id"], r["_words"], r["_starts"], r["_removes"]) for r in rows)
        if not self.ordered:
            yield from self.judge(key, sorted(frames, key=lambda f: f[:2]))
            return
        held = list(frames)
        if held:
            self.waiting.appendList(held)
            self.set_timer(min(f[0] for f in held) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last, pages, _ = self.at_cursor()
        self.cursor.update((last, pages, None))
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        due, later = [], []
        for f in self.waiting.get():
            (due if f[0] <= passed else later).append(tuple(f))
        if later:
            self.waiting.put(later)
            self.set_timer(min(f[0] for f in later) // 1000)
        else:
            self.waiting.clear()
        yield from self.judge(key, sorted(due, key=lambda f: f[:2]))

    def at_cursor(self) -> tuple[int | None, int, int | None]:
        return tuple(self.cursor.get()) if self.cursor.exists() else (None, 0, None)

    def set_timer(self, ms: int) -> None:
        """One timer stands at the earliest waiting frame."""
        last, pages, now = self.at_cursor()
        if now is not None and now <= ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.cursor.update((last, pages, ms))

    def forget(self) -> None:
        self.kept.clear()
        self.seen.clear()

    def judge(self, key: Any, frames: list) -> Iterator[Row]:
        """Pages among frames that come in order."""
        last, pages, timer = self.at_cursor()
        if not frames:
            return
        if last is None and self.camera:
            last = frames[0][0] - round(CAMERA_LEAD * 1e6)
        kept: np.ndarray | None = None
        for at, frame, words, starts, removes in frames:
            words = bytes(words) if words is not None else None
            if starts:
                self.forget()
                last, pages, kept = (at - round(CAMERA_LEAD * 1e6) if self.camera else None), 0, None
            if removes is not None:
                held = list(self.kept.get())
                for gone in (tuple(x) for x in held if x[0] == removes):
                    self.seen.removeKey((gone[1],))
                rest = [tuple(x) for x in held if x[0] != removes]
                self.kept.put(rest) if rest else self.kept.clear()
                kept = None
                continue
            if words is None or last is not None and at - last < self.least:
                continue
            last = at
            if self.seen.containsKey((words,)):
                continue
            if kept is None:
                held = [bytes(x[1]) for x in self.kept.get()]
                kept = np.frombuffer(b"".join(held), np.int64).reshape(-1, len(words) // 8)
            own = np.frombuffer(words, np.int64)
            if len(kept) and int(bits_between(own, kept).min()) <= self.threshold:
                continue
            kept, pages = np.vstack([kept, own]), pages + 1
            self.kept.appendValue((frame, words))
            self.seen.updateValue((words,), (frame,))
            yield Row(session=key[0], id=frame, _at=at, ordinal=pages)
        self.cursor.update((last, pages, timer))

    def close(self) -> None:
        pass


def session_pages(frames: DataFrame, gap: float, threshold: int = 60, delay: str | None = None, camera: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """session, id, ts, ordinal of the kept frames. frames(session, id, ts, hash array<long>[, session_start][, remove_id]), streaming."""
    if delay and ttl_ms:
        raise ValueError("state ends by time only where frames are judged as they come: give delay or ttl_ms")
    spark = frames.sparkSession
    ship(spark)
    use_rocksdb(spark)
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    # a hash is sent as bytes; to_binary of hexadecimal words keeps that in the JVM, lowest byte first
    word = lambda w: F.reverse(F.array(*[F.substring(F.lpad(F.hex(w), 16, "0"), k, 2) for k in range(1, 17, 2)]))
    words = F.unhex(F.array_join(F.flatten(F.transform("hash", word)), ""))
    picked = frames.filter("session IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").select(
        "session", "id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), words.alias("_words"),
        (F.coalesce("session_start", F.lit(False)) if "session_start" in types else F.lit(False)).alias("_starts"),
        (F.col("remove_id") if "remove_id" in types else F.lit(None)).cast(types["id"]).alias("_removes"),
    )
    if delay:
        picked = picked.withWatermark("ts", delay)
    capture = Capture(gap, threshold, types["id"], delay is not None, camera, ttl_ms)
    out = picked.groupBy("session").transformWithState(capture, f"session {types['session']}, id {types['id']}, _at long, ordinal int", "append", "eventTime" if delay else "processingTime" if ttl_ms else "none")
    return out.select("session", "id", F.timestamp_micros("_at").alias("ts"), "ordinal")
