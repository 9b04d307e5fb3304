"""Outer contours of a mask: run-length labelling with union-find, border following, the polygon's area, its smallest rectangle.

A region is 8-connected. Contours run through the centres of border pixels, so a filled sheet of w x h pixels has the area
(w - 1) * (h - 1), a concave sheet less than its hull, and a line none. Regions that lie in a hole of another have no outer contour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.shipping import ship


@dataclass(frozen=True)
class Runs:
    """Runs of set pixels in reading order: row, first column, column after the last; and the region of each, numbered from 0 in reading order."""

    row: np.ndarray
    first: np.ndarray
    end: np.ndarray
    region: np.ndarray


def runs(mask: np.ndarray, diagonal: bool = True) -> Runs:
    """``diagonal``: pixels that touch at a corner belong together."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    f, e, reach = first.tolist(), end.tolist(), int(diagonal)
    for y in range(1, mask.shape[0]):
        i, j = starts[y - 1], starts[y]
        while i < starts[y] and j < starts[y + 1]:
            if f[i] < e[j] + reach and f[j] < e[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    top = np.array([find(i) for i in range(len(root))], int)
    return Runs(row, first, end, np.unique(top, return_inverse=True)[1] if len(top) else top)


def labels(mask: np.ndarray) -> np.ndarray:
    """Region of every pixel from 1, 0 for background."""
    r, out = runs(mask), np.zeros(mask.shape, int)
    for y, a, b, k in zip(r.row, r.first, r.end, r.region):
        out[y, a:b] = k + 1
    return out


def follow(mask: np.ndarray, y: int, x: int) -> np.ndarray:
    """The outer border, as x, y of pixel centres, of the region whose first pixel in reading order is (y, x)."""
    wide = mask.shape[1] + 2
    flat = np.pad(mask.astype(np.uint8), 1).tobytes()
    around = (-1, -wide - 1, -wide, -wide + 1, 1, wide + 1, wide, wide - 1)  # clockwise from the left
    start = (y + 1) * wide + x + 1
    second = next((start + d for d in around if flat[start + d]), None)
    if second is None:
        return np.array([[x, y]])
    turn = {d: k for k, d in enumerate(around)}
    points, behind, here = [], second, start
    while True:
        k = turn[behind - here]
        ahead = next(here + around[(k - s) % 8] for s in range(1, 9) if flat[here + around[(k - s) % 8]])
        points.append(here)
        if ahead == start and here == second:
            break
        behind, here = here, ahead
    at = np.array(points)
    return np.stack([at % wide - 1, at // wide - 1], 1)


def area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)) / 2


def outer(mask: np.ndarray, least: float = 0.0) -> list[np.ndarray]:
    """The outer contours in reading order of their first pixels; those whose box can't hold an area of ``least`` stay out."""
    r = runs(mask)
    if not len(r.row):
        return []
    ground = np.pad(mask, 1) == 0
    b = runs(ground, diagonal=False)  # the background touches by sides alone; what holds the corner is outside
    out = []
    begins = np.unique(r.region, return_index=True)[1]
    for k, i in enumerate(begins):
        y, x = int(r.row[i]), int(r.first[i])
        near = np.searchsorted(b.row * (mask.shape[1] + 3) + b.first, (y + 1) * (mask.shape[1] + 3) + x, side="right") - 1  # the run that holds the pixel on the left
        if b.region[near] != b.region[0]:
            continue
        own = r.region == k
        if (r.end[own].max() - 1 - r.first[own].min()) * (r.row[own].max() - y) >= least:
            out.append(follow(mask, y, x))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points on its edges."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts.astype(float)

    def chain(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    held = pts.tolist()
    return np.array(chain(held) + chain(held[::-1]), float)


def callipers(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, degrees of the smallest rectangle around the points. One side lies on an edge of the hull; as the edge turns, the three
    points that touch the other sides move on and never back."""
    h = hull(points)
    n = len(h)
    if n < 3:
        d, mid = h[-1] - h[0], (h[0] + h[-1]) / 2
        return _upright(*mid, np.hypot(*d), 0.0, np.degrees(np.arctan2(d[1], d[0])))
    p = h.tolist()
    right = top = left = 1
    best = None
    for i in range(n):
        (ax, ay), (bx, by) = p[i], p[(i + 1) % n]
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        ux, uy = (bx - ax) / size, (by - ay) / size
        along = lambda k: p[k % n][0] * ux + p[k % n][1] * uy  # noqa: E731,B023
        away = lambda k: p[k % n][1] * ux - p[k % n][0] * uy  # noqa: E731,B023
        right = max(right, i + 1)
        while along(right + 1) > along(right):
            right += 1
        top = max(top, right)
        while away(top + 1) > away(top):
            top += 1
        left = max(left, top)
        while along(left + 1) < along(left):
            left += 1
        low, w, t = along(left), along(right) - along(left), away(top) - away(i)
        if best is None or w * t < best[0] - 1e-9:
            a, b = low + w / 2, away(i) + t / 2
            best = (w * t, (a * ux - b * uy, a * uy + b * ux, w, t, np.degrees(np.arctan2(uy, ux))))
    return _upright(*best[1])


def _upright(cx: float, cy: float, w: float, h: float, deg: float) -> tuple[float, float, float, float, float]:
    """The same rectangle by the side whose angle lies from 0 to under 90 degrees."""
    if deg % 180 >= 90:
        w, h = h, w
    return float(cx), float(cy), float(w), float(h), float(deg % 90)


def largest(mask: np.ndarray, low: float = 0.15, high: float = 0.97) -> np.ndarray | None:
    """Of the outer contours whose area is a share of the frame from ``low`` to ``high``, the one of the largest area, the first of equals."""
    best, most = None, 0.0
    for points in outer(mask, low * mask.size):
        own = area(points)
        if own > most and low * mask.size <= own <= high * mask.size:
            best, most = points, own
    return best


def contour_stats(masks: DataFrame, id_col: str, mask_col: str, width: int, low: float = 0.15, high: float = 0.97) -> DataFrame:
    """id_col, contours, largest_area, gated_area (null if none passes), rect_area (of the gated contour's smallest rectangle) for rows whose mask
    is an array of 0 and 1, row by row. A null mask, or one that has no whole rows, has no contours."""
    ship(masks.sparkSession)
    schema = masks.select(id_col).schema.add("contours", "long").add("largest_area", "double").add("gated_area", "double").add("rect_area", "double")

    def of(flat: np.ndarray | None) -> tuple:
        if flat is None or not len(flat) or len(flat) % width:
            return 0, 0.0, None, None
        mask = flat.reshape(-1, width) > 0
        found, best = outer(mask), largest(mask, low, high)
        rect = callipers(best)[2:4] if best is not None else None
        return len(found), max(map(area, found), default=0.0), None if best is None else area(best), None if rect is None else rect[0] * rect[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            rows = [of(held[i].values.to_numpy(zero_copy_only=False) if held[i].is_valid else None) for i in range(batch.num_rows)]
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], schema.names)

    return masks.select(id_col, mask_col).mapInArrow(run, schema)
