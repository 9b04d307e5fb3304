"""Detection post-processing: score, class routing, rescaling, dilation, rounding, clipping, size, suppression.

Input rows: one raw detection each, x1 y1 x2 y2 in the model's square, score, 1-based class_id, and optionally char_count.
All steps but suppression are one projection and filter, so Catalyst fuses them with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import js_round
from foliant.operators.folds import greedy_nms

#: Class 0 is a block, these are lines.
LINE_CLASSES = (1, 2, 3, 4, 5, 16)
MODEL_SIDE, MIN_SCORE, MIN_SIDE, DILATION = 800, 0.3, 10, 0.02


def route(class_id: Column) -> Column:
    """block, line or null of a 1-based class id."""
    c = class_id - 1
    return F.when(c == 0, "block").when(c.isin(*LINE_CLASSES), "line")


def boxes(raw: DataFrame, width: str = "img_w", height: str = "img_h", min_score: float = MIN_SCORE) -> DataFrame:
    """raw plus kind, x, y, width, height (integers in the image) of what passes; a NaN score passes."""
    scale = F.greatest(width, height).cast("double") / MODEL_SIDE
    c = {k: F.col(k).cast("double") * scale for k in ("x1", "y1", "x2", "y2")}
    more = F.when(F.col("kind") == "line", (c["y2"] - c["y1"]) * DILATION).otherwise(F.lit(0.0))
    low = lambda v: F.greatest(F.lit(0), js_round(v))
    high = lambda v, most: F.least(F.col(most).cast("long"), js_round(v))
    kept = raw.filter(~(F.col("score") < min_score)).withColumn("kind", route(F.col("class_id"))).filter("kind IS NOT NULL")
    x, y = low(c["x1"]), low(c["y1"] - more)
    sized = kept.withColumns({"_w": high(c["x2"], width) - x, "_h": high(c["y2"] + more, height) - y, "x": x, "y": y})
    out = sized.filter((F.col("_w") >= MIN_SIDE) & (F.col("_h") >= MIN_SIDE))
    return out.drop(*[k for k in ("width", "height") if k in raw.columns and k not in (width, height)]).withColumnsRenamed({"_w": "box_w", "_h": "box_h"})


def postprocess(raw: DataFrame, page: str, order: str, threshold: float = 0.5, **names: str) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks): lines after suppression, blocks as they are."""
    found = boxes(raw, **names).withColumnsRenamed({"box_w": "width", "box_h": "height"})
    char_count = F.coalesce(F.col("char_count"), F.lit(100)) if "char_count" in raw.columns else F.lit(100)
    lines = found.filter("kind = 'line'").withColumn("char_count", char_count)
    kept = greedy_nms(lines, [page], "score", [order], threshold, [order, "class_id", "char_count"])
    return kept, found.filter("kind = 'block'").select(page, order, "x", "y", "width", "height")


def mask_corners(cells: DataFrame, keys: list[str], corner: str, threshold: float, parts: int = 4) -> DataFrame:
    """Weighted centroid of each corner's heatmap cells (x, y, w) above the threshold; keys without all corners go."""
    hot = cells.filter(F.col("w") > threshold)
    each = hot.groupBy(*keys, corner).agg(
        (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("cx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("cy")
    )
    whole = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == parts).drop("n")
    return each.join(whole, keys)
