"""Live sampling and dedup of frames with state by session; batch folds give the same rows for ordered input.

Rows inside a micro-batch come unordered, so each is sorted by (ts, id) before the greedy step. State
ends after ``ttl_ms`` without frames, which is this engine's own extension. A frame whose ``session_start`` column is true
begins its session anew: what was kept before is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds before now at which a camera session's last frame is taken to be.
CAMERA_LEAD = 10.0


def _stateful(frames: DataFrame, fresh: Callable, walk: Callable, kind: str, ttl_ms: int | None) -> DataFrame:
    """frames of which ``walk(sorted rows, state)`` keeps some; it returns flags and the new state."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(rows).sort_values(["ts", "id"], kind="stable")
        held = state.get[0] if state.exists else fresh(pdf)
        flags, held = walk(pdf, held)
        state.update((held,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pdf[flags]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy("session").applyInPandasWithState(step, frames.schema, kind, "append", timeout)


def throttle(frames: DataFrame, gap: float, ttl_ms: int | None = None, camera: bool = False, gap_col: str | None = None) -> DataFrame:
    """frames(session, id, ts, ...), streaming: those ``gap`` seconds or more after the last taken one of their session.

    The state is the last taken time in microseconds. A recording's first frame is always taken. ``camera``: the last frame counts as taken ``CAMERA_LEAD``
    seconds before the session's first, so a longer gap holds the first back. ``gap_col``: each frame's own gap in seconds, as
    ``adaptive_gap`` gives it, in place of ``gap``; null takes ``gap``.
    """
    least = round(gap * 1e6)

    def first(at: int) -> int | None:
        return at - round(CAMERA_LEAD * 1e6) if camera else None

    def fresh(pdf: pd.DataFrame) -> int | None:
        return first(int(pdf["ts"].astype("datetime64[us]").astype("int64").iloc[0])) if len(pdf) else None

    def walk(pdf: pd.DataFrame, last: int | None) -> tuple[list[bool], int | None]:
        starts = pdf["session_start"].fillna(False).tolist() if "session_start" in pdf else [False] * len(pdf)
        gaps = [least if pd.isna(g) else round(g * 1e6) for g in pdf[gap_col]] if gap_col else [least] * len(pdf)
        taken = []
        for at, begins, need in zip(pdf["ts"].astype("datetime64[us]").astype("int64"), starts, gaps):
            last = first(int(at)) if begins else last
            taken.append(last is None or at - last >= need)
            last = int(at) if taken[-1] else last
        return taken, last

    return _stateful(frames, fresh, walk, "last long", ttl_ms)


def bits_between(words: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Hamming distances of one hash (words) to many."""
    return np.bitwise_count(np.bitwise_xor(kept.view(np.uint64), words.view(np.uint64))).sum(1)


def dedup(frames: DataFrame, threshold: int = 60, words: int = 4, ttl_ms: int | None = None) -> DataFrame:
    """frames(session, id, ts, hash), streaming: those over ``threshold`` bits from all frames kept before in their session."""

    def walk(pdf: pd.DataFrame, raw: bytes) -> tuple[list[bool], bytes]:
        kept = np.frombuffer(raw, np.int64).reshape(-1, words)
        starts = pdf["session_start"].fillna(False).tolist() if "session_start" in pdf else [False] * len(pdf)
        new, fresh = [], []
        for h, begins in zip(pdf["hash"], starts):
            if begins:
                kept, fresh = np.empty((0, words), np.int64), []
            h = np.asarray(h, np.int64)
            near = [bits_between(h, k).min() for k in (kept, np.array(fresh, np.int64).reshape(-1, words)) if len(k)]
            new.append(not near or int(min(near)) > threshold)
            if new[-1]:
                fresh.append(h)
        return new, np.vstack([kept, np.array(fresh, np.int64).reshape(-1, words)]).tobytes()

    return _stateful(frames, lambda pdf: b"", walk, "kept binary", ttl_ms)


#: The states of a capture pipeline, and which may follow which.
PIPELINE_TRANSITIONS = {
    "idle": ("active", "error"),
    "active": ("capturing", "review", "idle", "error"),
    "capturing": ("active", "review", "idle", "error"),
    "review": ("active", "idle", "error"),
    "error": ("idle", "active"),
}


def adaptive_gaps(frames: DataFrame, state: str, fps: float = 10.0, most: float = 15.0, name: str = "gap") -> DataFrame:
    """frames with each one's gap in seconds by the pipeline's state; ``throttle`` takes it as ``gap_col``."""
    idle: Column = F.coalesce(F.col(state) == "idle", F.lit(False))
    return frames.withColumn(name, F.when(idle, F.lit(adaptive_gap("idle", fps, most))).otherwise(F.lit(adaptive_gap("active", fps, most))))


def adaptive_gap(state: str, fps: float = 10.0, most: float = 15.0) -> float:
    """Seconds between frames: half the rate when idle, the rate when active, never over ``most`` frames a second."""
    rate = min(fps / 2 if state == "idle" else fps, most)
    return 1.0 / rate


def persist(stream: DataFrame, path: str, checkpoint: str, on_batch=None):
    """Appends each micro-batch to a table; its id makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
