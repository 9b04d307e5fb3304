"""Reading order by recursive cuts of a page's occupancy grid, one page at a time in a worker.

A page is a grid of at most 101 cells on its long side, filled where boxes lie. A region is cut along the axis
whose emptiest run scores nearest to zero (-min/max of the histogram), into before, run and after. Boxes go to
the region they overlap best. Pages whose lines are mostly upright read their columns from right to left.

The grid is never laid out: between two box edges all columns hold the same cells, so each axis is a short list of stretches with
the cells across as the bits of an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRID = 100
BOX = ("x", "y", "width", "height")
COVERAGE = 0.7
#: From this many pairs on, overlaps are taken with numpy.
PAIRS = 600


@dataclass
class Region:
    box: tuple[int, int, int, int]  # x0, y0, x1, y1
    parts: list[Region] = field(default_factory=list)
    by_x: bool = False
    lines: list[int] = field(default_factory=list)


def to_grid(boxes: list) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Boxes (x0, y0, x1, y1) in cells, and the grid's width and height; without an extent all boxes are one cell."""
    x0, y0, x1, y1 = zip(*boxes)
    lows, spans, sides, cells = (min(x0), min(y0)), (max(x1) - min(x0), max(y1) - min(y0)), [], []
    if not all(spans):
        return [(0, 0, 1, 1)] * len(boxes), 2, 2
    longest = max(spans)
    sides = [GRID * s / longest for s in spans]
    w, h = (math.ceil(s) + 1 for s in sides)
    for b in boxes:
        at = []
        for k, most in ((0, w - 1), (1, h - 1)):
            first = max(0, math.floor((b[k] - lows[k]) * sides[k] / spans[k]))
            last = min(most, math.ceil((b[k + 2] - lows[k]) * sides[k] / spans[k]))
            at.append((first, max(first + 1, last)))
        cells.append((at[0][0], at[1][0], at[0][1], at[1][1]))
    return cells, w, h


def stretches(cells: list[tuple[int, int, int, int]], axis: int, size: int) -> list[tuple[int, int, int]]:
    """(start, end, filled cells across as bits) along the axis; they cover 0..size."""
    edges = sorted({0, size, *(c[axis] for c in cells), *(c[axis + 2] for c in cells)})
    spans = [(c[axis], c[axis + 2], (1 << c[3 - axis]) - (1 << c[1 - axis])) for c in cells]
    out = []
    for a, b in zip(edges, edges[1:]):
        bits = 0
        for first, last, across in spans:
            if first <= a < last:
                bits |= across
        out.append((a, b, bits))
    return out


def emptiest_run(along: list[tuple[int, int, int]], lo: int, hi: int, across_lo: int, across_hi: int) -> tuple[int, int, float]:
    """(start, end, score) of the first longest run of the smallest count of filled cells within a region."""
    if hi - lo <= 1:
        return lo, hi, 0.0
    seen = (1 << across_hi) - (1 << across_lo)
    low, high, start, end, best = 1 << 30, 0, 0, 0, (lo, lo)
    for a, b, bits in along:
        if b <= lo or a >= hi:
            continue
        a, b, n = max(a, lo), min(b, hi), (bits & seen).bit_count()
        high = max(high, n)
        if n < low:
            low, start, end, best = n, a, b, (a, b)
        elif n == low:
            start, end = (start if end == a else a), b
            if end - start > best[1] - best[0]:
                best = start, end
    return *best, -low / high if high else 0.0


def divide(columns: list, rows: list, root: Region) -> list[Region]:
    """Cuts until nothing can be cut; the leaves in the order of the cuts."""
    leaves, todo = [], [root]
    while todo:
        r = todo.pop()
        x0, y0, x1, y1 = r.box
        xs, ys = emptiest_run(columns, x0, x1, y0, y1), emptiest_run(rows, y0, y1, x0, x1)
        if xs[:2] != (x0, x1) or ys[:2] != (y0, y1):
            r.by_x = xs[2] > ys[2] or xs[2] == ys[2] and xs[1] - xs[0] >= ys[1] - ys[0]
            at = [x0, *xs[:2], x1] if r.by_x else [y0, *ys[:2], y1]
            cut = [(a, y0, b, y1) if r.by_x else (x0, a, x1, b) for a, b in zip(at, at[1:]) if a < b]
            r.parts = [Region(b) for b in cut if b != r.box]
        if r.parts:
            todo += reversed(r.parts)
        else:
            leaves.append(r)
    return leaves


def best_overlap(boxes: list, leaves: list) -> list[int]:
    """For each box the leaf of largest IoU, the first of equals."""
    if len(boxes) * len(leaves) >= PAIRS:
        b, leaf = np.array(boxes), np.array(leaves)
        side = lambda k: np.clip(np.minimum(b[:, None, k + 2], leaf[None, :, k + 2]) - np.maximum(b[:, None, k], leaf[None, :, k]), 0, None)
        inter = side(0) * side(1)
        size = lambda v: (v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1])
        return (inter / (size(b)[:, None] + size(leaf)[None, :] - inter)).argmax(1).tolist()
    out = []
    areas = [(c - a) * (d - b) for a, b, c, d in leaves]
    for x0, y0, x1, y1 in boxes:
        mine, best, found = (x1 - x0) * (y1 - y0), -1.0, 0
        for k, (a, b, c, d) in enumerate(leaves):
            w, h = min(x1, c) - max(x0, a), min(y1, d) - max(y0, b)
            share = w * h / (mine + areas[k] - w * h) if w > 0 and h > 0 else 0.0
            if share > best:
                best, found = share, k
        out.append(found)
    return out


def ranks(boxes: list) -> list[int]:
    """Reading rank from 0 of every box (x0, y0, x1, y1)."""
    n = len(boxes)
    if n < 2:
        return [0] * n
    cells, w, h = to_grid(boxes)
    root = Region((0, 0, w, h))
    leaves = divide(stretches(cells, 0, w), stretches(cells, 1, h), root)
    for i, leaf in enumerate(best_overlap(cells, [r.box for r in leaves])):
        leaves[leaf].lines.append(i)
    upright = [x1 - x0 < y1 - y0 for x0, y0, x1, y1 in cells]

    def read(r: Region) -> list[int]:
        if r.lines:
            tall = len(r.lines) < 2 * sum(upright[i] for i in r.lines)
            key = (lambda i: (-cells[i][0], cells[i][1])) if tall else (lambda i: (cells[i][1], cells[i][0]))
            return sorted(r.lines, key=key)
        runs = [read(p) for p in r.parts]
        inside = [i for run in runs for i in run]
        if r.by_x and len(inside) < 2 * sum(upright[i] for i in inside):
            runs.reverse()
        return [i for run in runs for i in run]

    out = [0] * n
    for place, i in enumerate(read(root)):
        out[i] = place
    return out


def page_order(boxes: list, blocks: list | None = None) -> list[int]:
    """Order from 1 of a page's valid lines (x, y, w, h), with or without blocks (x, y, w, h)."""
    n = len(boxes)
    rect = [(x, y, x + w, y + h) for x, y, w, h in boxes]
    if n < 2 or not blocks:
        return [k + 1 for k in ranks(rect)]
    of = []
    for x, y, w, h in boxes:
        cx, cy = x + w / 2, y + h / 2
        of.append(next((k for k, (a, b, c, d) in enumerate(blocks) if a <= cx <= a + c and b <= cy <= b + d), -1))
    if sum(k >= 0 for k in of) < COVERAGE * n:
        return [k + 1 for k in ranks(rect)]
    groups = [[i for i in range(n) if of[i] == k] for k in dict.fromkeys(k for k in of if k >= 0)] + [[i] for i in range(n) if of[i] < 0]
    corners = [list(zip(*(rect[i] for i in g))) for g in groups]
    outer = ranks([(min(c[0]), min(c[1]), max(c[2]), max(c[3])) for c in corners])
    out, place = [0] * n, 0
    for k in sorted(range(len(groups)), key=outer.__getitem__):
        inner = ranks([rect[i] for i in groups[k]])
        for j in sorted(range(len(inner)), key=inner.__getitem__):
            place += 1
            out[groups[k][j]] = place
    return out


def reading_order(lines: DataFrame, page: str, line_id: str, blocks: DataFrame | None = None, block_id: str = "block_id", min_confidence: float = 0.1) -> DataFrame:
    """page, line_id, reading_order of the valid lines: confidence high enough and text not blank.

    lines: x, y, width, height, and confidence and text where they are known.
    """
    if "confidence" in lines.columns:
        lines = lines.filter(F.col("confidence") >= min_confidence)
    if "text" in lines.columns:
        from foliant.functions.text import unicode_trim

        lines = lines.filter(unicode_trim(F.col("text")) != "")
    row = F.struct(F.col(line_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    pages = lines.groupBy(page).agg(F.array_sort(F.collect_list(row)).alias("lines"))
    if blocks is not None:
        block = F.struct(F.col(block_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX])
        pages = pages.join(blocks.groupBy(page).agg(F.array_sort(F.collect_list(block)).alias("blocks")), page, "left")
    else:
        pages = pages.withColumn("blocks", F.lit(None).cast("array<struct<id:int,x:double,y:double,width:double,height:double>>"))
    held = pages.select(page, F.col("lines.id").alias("ids"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("lines", "blocks") for c in BOX])

    def boxes_of(batch: pa.RecordBatch, side: str) -> list[list]:
        """Of each row its boxes; a null array has none."""
        cols = [batch.column(f"{side}_{c}") for c in BOX]
        ends = np.cumsum(cols[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        flat = list(zip(*(c.flatten().to_pylist() for c in cols)))
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = list(map(page_order, boxes_of(batch, "lines"), boxes_of(batch, "blocks")))
            yield pa.RecordBatch.from_arrays([batch.column(page), batch.column("ids"), pa.array(orders, pa.list_(pa.int32()))], [page, "ids", "orders"])

    types = dict(held.dtypes)
    out = held.mapInArrow(run, f"{page} {types[page]}, ids {types['ids']}, orders array<int>")
    return out.select(page, F.explode(F.arrays_zip("ids", "orders")).alias("z")).select(page, F.col("z.ids").alias(line_id), F.col("z.orders").alias("reading_order"))


def page_grid(df: DataFrame, page: str) -> DataFrame:
    """df with gx0, gy0, gx1, gy1, grid_w, grid_h: its boxes in the cells of their page's grid."""
    over = W.partitionBy(page)
    x1, y1 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    df = df.withColumns({"_x0": F.min("x").over(over), "_y0": F.min("y").over(over), "_x1": F.max(x1).over(over), "_y1": F.max(y1).over(over)})
    w, h = (F.col("_x1") - F.col("_x0")).cast("double"), (F.col("_y1") - F.col("_y0")).cast("double")
    flat = (w == 0) | (h == 0)
    df = df.withColumns({"_w": w, "_h": h, "_sx": F.when(h >= w, GRID * (w / h)).otherwise(float(GRID)), "_sy": F.when(h >= w, float(GRID)).otherwise(GRID * (h / w))})
    gw, gh = F.ceil("_sx") + 1, F.ceil("_sy") + 1
    low = lambda v, v0, side, ext: F.greatest(F.lit(0), F.floor((v - F.col(v0)) * F.col(side) / F.col(ext)))
    high = lambda v, v0, side, ext, n: F.least(n - 1, F.ceil((v - F.col(v0)) * F.col(side) / F.col(ext)))
    a, b = low(F.col("x"), "_x0", "_sx", "_w"), low(F.col("y"), "_y0", "_sy", "_h")
    c, d = F.greatest(a + 1, high(x1, "_x0", "_sx", "_w", gw)), F.greatest(b + 1, high(y1, "_y0", "_sy", "_h", gh))
    pick = lambda one, v: F.when(flat, F.lit(one)).otherwise(v).cast("int")
    out = df.withColumns({"gx0": pick(0, a), "gy0": pick(0, b), "gx1": pick(1, c), "gy1": pick(1, d), "grid_w": pick(2, gw), "grid_h": pick(2, gh)})
    return out.drop("_x0", "_y0", "_x1", "_y1", "_w", "_h", "_sx", "_sy")


def column_counts(gridded: DataFrame, page: str) -> DataFrame:
    """page, cx, n: for every column of the page's grid, the number of its filled cells.

    A box gives each of its columns the cells that it fills as the bits of two longs; a page's last box also gives the page's other columns, empty.
    Bits are joined by ``bit_or``, all in generated code and in the partitions that the grid's window already has.
    """
    ones = lambda n: F.when(n >= 64, F.lit(-1).cast("long")).when(n <= 0, F.lit(0).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))))
    low = ones(F.col("gy1")).bitwiseXOR(ones(F.col("gy0")))
    high = ones(F.col("gy1") - 64).bitwiseXOR(ones(F.col("gy0") - 64))
    last = F.row_number().over(W.partitionBy(page).orderBy("gx0", "gx1", "gy0", "gy1")) == 1
    spans = gridded.select(page, "gx0", "gx1", "grid_w", low.alias("low"), high.alias("high"), last.alias("all"))
    cx = F.explode(F.sequence(F.when(F.col("all"), 0).otherwise(F.col("gx0")), F.when(F.col("all"), F.col("grid_w")).otherwise(F.col("gx1")) - 1)).alias("cx")
    cells = spans.select(page, "gx0", "gx1", "low", "high", cx)
    there = (F.col("gx0") <= F.col("cx")) & (F.col("cx") < F.col("gx1"))
    masks = [F.bit_or(F.when(there, F.col(m)).otherwise(F.lit(0).cast("long"))).alias(m) for m in ("low", "high")]
    return cells.groupBy(page, "cx").agg(*masks).select(page, "cx", (F.bit_count("low") + F.bit_count("high")).cast("int").alias("n"))


def column_histogram(gridded: DataFrame, page: str) -> DataFrame:
    """page, hist: the counts of the page's columns, in order."""
    cells = F.sort_array(F.collect_list(F.struct("cx", "n")))
    return column_counts(gridded, page).groupBy(page).agg(cells["n"].alias("hist"))


def longest_minimum_run(counts: DataFrame, page: str) -> DataFrame:
    """page, start, end, score of counts(page, cx, n): the first longest run of the smallest value; score is -min/max.

    Pages of one column give (0, 1, 0). Smallest columns that follow each other have the same difference of column and place.
    """
    over = W.partitionBy(page)
    low = counts.withColumns({"low": F.min("n").over(over), "high": F.max("n").over(over), "cols": F.count(F.lit(1)).over(over)}).filter("n = low")
    run = low.withColumn("run", F.col("cx") - F.row_number().over(over.orderBy("cx")))
    runs = run.groupBy(page, "run").agg(F.count(F.lit(1)).cast("int").alias("len"), F.min("cx").alias("start"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("cols").alias("cols"))
    best = runs.groupBy(page).agg(F.min(F.struct((-F.col("len")).alias("l"), "start", "low", "high", "cols")).alias("r"))
    score = F.when((F.col("r.cols") > 1) & (F.col("r.high") > 0), -F.col("r.low") / F.col("r.high")).otherwise(0.0)
    return best.select(page, F.col("r.start").alias("start"), (F.col("r.start") - F.col("r.l")).alias("end"), score.cast("double").alias("score"))
