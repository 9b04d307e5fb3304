"""Evaluation of a capture run: sampling, sharpness, running page numbers, summary, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.geometry import js_round


def every_kth(frames: DataFrame, idx: str, fps: float, interval: float) -> DataFrame:
    """Frames whose index divides by int(fps * interval), 15 without a frame rate; an interval under a frame is an error."""
    k = int(fps * interval) if fps > 0 else 15
    if k < 1:
        raise ValueError("interval is shorter than one frame")
    return frames.filter(F.col(idx) % k == 0)


def running_pages(frames: DataFrame, keys: list[str], order: list[str], detected: str = "detected") -> DataFrame:
    over = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return frames.withColumn("page", F.when(F.col(detected), F.sum(F.col(detected).cast("long")).over(over)))


def summary(frames: DataFrame, keys: list[str], detected: str = "detected", sharpness: str = "sharpness", detect_ms: str = "detect_ms") -> DataFrame:
    """Totals; means run over values rounded to one decimal, and are 0 without rows."""
    n, found = F.count(F.lit(1)), F.count_if(F.col(detected))
    mean = lambda c: F.coalesce(F.avg(F.bround(F.col(c), 1)), F.lit(0.0))
    return frames.groupBy(*keys).agg(
        n.alias("total"), found.alias("found"), F.coalesce(F.try_divide(found * 100.0, n), F.lit(0.0)).alias("rate"), found.alias("pages"),
        mean(detect_ms).alias("mean_detect_ms"), mean(sharpness).alias("mean_sharpness"),
    )


def laplacian_variance(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the 4-neighbour Laplacian of a row-major image; edges are mirrored without repeating the border."""
    at = lambda x, y: F.element_at(pixels, y * width + x + 1).cast("double")
    mirror = lambda v, n: F.when(v < 0, -v).when(v >= n, F.lit(2 * n - 2) - v).otherwise(v).cast("int")

    def value(i: Column) -> Column:
        x, y = (i % width).cast("int"), F.floor(i / width).cast("int")
        return at(mirror(x - 1, width), y) + at(mirror(x + 1, width), y) + at(x, mirror(y - 1, height)) + at(x, mirror(y + 1, height)) - 4 * at(x, y)

    lap = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), value)
    n = float(width * height)
    add = lambda a, v: a + v
    mean = F.aggregate(lap, F.lit(0.0), add) / n
    return F.aggregate(lap, F.lit(0.0), lambda a, v: a + v * v) / n - mean * mean


def sharp_enough(frames: DataFrame, sharpness: str = "sharpness", least: float = 100.0) -> DataFrame:
    """The blur gate: frames whose Laplacian variance reaches ``least``; unknown sharpness goes."""
    return frames.filter(F.col(sharpness) >= least)


def seconds_text(seconds: Column) -> Column:
    """Seconds with one decimal and the unit."""
    return F.format_string("%.1fs", seconds.cast("double"))


def progress(done: Column, total: Column) -> Column:
    """Rounded per cent, 0 without a length."""
    return F.when(total > 0, js_round(done / total * 100)).otherwise(F.lit(0).cast("long"))


def stage_progress(stage: Column, part: Column, index: Column | None = None, n: Column | None = None) -> Column:
    """Overall progress of loading (mean of the models), detecting, and recognising line ``index`` of ``n``."""
    line = F.try_divide(index.cast("double"), n.cast("double")) if index is not None and n is not None else F.lit(0.0)
    return F.when(stage == "loading", part * 0.73 + 0.02).when(stage == "layout", part * 0.3 + 0.1).when(stage == "recognition", line * 0.4 + 0.4)


def frame_name(n: Column) -> Column:
    return F.format_string("page-%03d.jpg", n)


def stability(frames: DataFrame, keys: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """state: unknown for the first frame, else stable or moving by the change since the frame before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return frames.withColumn("state", F.when(before.isNull(), "unknown").when(F.abs(F.col(value) - before) <= threshold, "stable").otherwise("moving"))


def best_stable(frames: DataFrame, keys: list[str], order: str, quality: str) -> DataFrame:
    """The best frame of each unbroken run of stable frames, first of equals. frames: with ``state``."""
    over = W.partitionBy(*keys).orderBy(order)
    run = frames.withColumn("run", F.sum((F.col("state") != "stable").cast("long")).over(over)).filter("state = 'stable'")
    best = F.min(F.struct((-F.col(quality)).alias("q"), F.col(order).alias("o")))
    return run.groupBy(*keys, "run").agg(best.alias("m")).select(*keys, "run", F.col("m.o").alias(order), (-F.col("m.q")).alias(quality))


def quality(blur: Column, glare: Column, occlusion: Column, weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> Column:
    """Overall quality; the weights are this engine's own default."""
    return blur * weights[0] + glare * weights[1] + occlusion * weights[2]


#: Which state may follow which.
TRANSITIONS = {
    "idle": ("loading", "scanning", "error"),
    "loading": ("scanning", "error", "idle"),
    "scanning": ("done", "error", "idle"),
    "done": ("loading", "scanning", "idle"),
    "error": ("loading", "scanning", "idle"),
}


def transitions(events: DataFrame, keys: list[str], order: list[str], state: str, allowed: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Every event with ``previous`` and ``valid``: may its state follow the one before? A first state always may."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to])
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    said = events.withColumn("previous", before)
    return said.withColumn("valid", F.col("previous").isNull() | F.array_contains(pairs, F.concat_ws(">", "previous", state)))
