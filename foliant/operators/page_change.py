"""Page changes: is a frame like the one before it in its session? Plugged-in detectors with a memory, and the difference of two frames as columns.

States are ``unknown`` (nothing to compare with), ``stable`` and ``moving``.

Defined results: a null session is a session; frames without pixels or a size are left out, so the frame after one is compared with the one
before it; rows with equal order values come in any order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.backends import SIZED
from foliant.operators.images import image_of
from foliant.shipping import ship
from foliant.sources.shared import staged

#: What a detector may answer.
STATES = ("stable", "moving", "unknown")


class FrameDifference:
    """Stable if grey levels differ by ``threshold`` at most in the mean; a frame of another size moves."""

    def __init__(self, threshold: float = 8.0):
        self.threshold = threshold
        self.reset()

    def reset(self) -> None:
        self.before: np.ndarray | None = None

    def process(self, image: np.ndarray) -> str:
        grey, before = image.mean(2), self.before
        self.before = grey
        if before is None:
            return "unknown"
        return "stable" if grey.shape == before.shape and np.abs(grey - before).mean() <= self.threshold else "moving"


def page_changes(frames: DataFrame, make: Callable[[], Any], keys: list[str], order: list[str], name: str = "state") -> DataFrame:
    """keys, order and the state of frames(keys, order, pixels, width, height, channels), from ``make()``: an object with ``process(image)``, which sees
    a session's frames in order, and ``reset()``, called before each session.

    A detector may remember anything, so a session is walked by one task; its frames pass one Arrow batch after the other,
    sorted by the shuffle, and no group is ever held. ``frame_changes`` has no such task.
    """
    ship(frames.sparkSession)
    held = [*keys, *order]
    image = ["pixels", "width", "height", "channels"]
    walked = frames.filter(SIZED).select(*held, *image).repartition(*keys).sortWithinPartitions(*held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = make()
        getattr(detector, "warm_up", lambda: None)()
        session = None
        try:
            for batch in batches:
                states = []
                for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(keys))])):
                    if key != session:
                        detector.reset()
                        session = key
                    states.append(detector.process(image_of(*[batch.column(len(held) + k)[i].as_py() for k in range(len(image))])))
                    if states[-1] not in STATES:
                        raise ValueError(f"a page change detector answered {states[-1]!r}")
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array(states, pa.string())], [*held, name])
        finally:
            getattr(detector, "dispose", lambda: None)()

    return walked.mapInArrow(run, frames.select(*held).schema.add(name, "string"))


def frame_changes(frames: DataFrame, keys: list[str], order: list[str], pixels: str, threshold: float = 8.0, name: str = "state") -> DataFrame:
    """keys, order and the state of frames whose small grey image is the array ``pixels``, by the rule of ``FrameDifference``, in the JVM.

    Frames are dealt out by ranges of (keys, order), so a session that holds a third of all frames is spread over tasks. A range's
    first frame is compared with the last of the range before: one row a range, broadcast.
    """
    held = [*keys, *order]
    rows = frames.filter(F.col(pixels).isNotNull()).select(*held, F.col(pixels).alias("_px"))
    rows = staged(rows.repartitionByRange(*held).withColumn("_range", F.spark_partition_id()), "frame-ranges")
    last = rows.groupBy("_range").agg(F.max_by(F.struct(*keys, "_px"), F.struct(*held)).alias("_last"))
    ends = last.select("_range", F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy("_range")).alias("_end"))  # one row a range
    inside = W.partitionBy("_range", *keys).orderBy(*order)
    rows = rows.withColumn("_lag", F.lag("_px").over(inside)).join(F.broadcast(ends), "_range")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col("_end")[k]) for k in keys), F.lit(True))
    before = F.coalesce("_lag", F.when(same, F.col("_end")["_px"]))
    return rows.select(*held, state_of(F.col("_px"), before, threshold).alias(name))


def state_of(px: Column, before: Column, threshold: float) -> Column:
    gaps = F.zip_with(px, before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / F.size(px)
    return F.when(before.isNull(), "unknown").when((F.size(px) == F.size(before)) & (mean <= threshold), "stable").otherwise("moving")
