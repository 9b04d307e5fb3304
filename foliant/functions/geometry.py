"""Geometry as Column expressions. Boxes are (x, y, width, height) columns, points struct<x,y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(v: Column) -> Column:
    """Half goes up, also below zero: floor(v + 0.5), as bigint."""
    return F.floor(v + F.lit(0.5))


def area_within(area: Column, frame_area: Column, low: float = 0.15, high: float = 0.97) -> Column:
    """Is the area between the two shares of the frame, both included?"""
    return area.between(frame_area * low, frame_area * high)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The four corners of a rectangle turned about its centre, as an array of points."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(*[point(cx + c * w * (i / 2) - s * h * (j / 2), cy + s * w * (i / 2) + c * h * (j / 2)) for i, j in signs])


def ordered_quad(points: Column) -> Column:
    """struct<tl,tr,br,bl>: extremes of x+y and y-x; the first of equal points wins."""
    keyed = lambda key, i: F.transform(points, lambda p, k: F.struct(key(p).alias("k"), (k * i).alias("i"), p.alias("p")))
    total, across = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.struct(
        F.array_min(keyed(total, 1))["p"].alias("tl"),
        F.array_min(keyed(across, 1))["p"].alias("tr"),
        F.array_max(keyed(total, -1))["p"].alias("br"),
        F.array_max(keyed(across, -1))["p"].alias("bl"),
    )


def shoelace(points: Column) -> Column:
    """Area of a simple polygon."""
    nxt = lambda i: F.element_at(points, (i + 1) % F.size(points) + 1)
    terms = F.transform(points, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def quad_valid(points: Column, frame_area: Column, share: float = 0.10) -> Column:
    """Four corners that turn one way (so simple and convex) and cover at least ``share`` of the frame."""
    at = lambda i: F.element_at(points, i % 4 + 1)

    def turn(i: int) -> Column:
        a, b, c = at(i), at(i + 1), at(i + 2)
        return F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))

    turns = [turn(i) for i in range(4)]
    return (F.size(points) == 4) & (F.abs(sum(turns[1:], turns[0])) == 4) & (shoelace(points) >= frame_area * share)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union; 0 without an intersection."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    return F.when(inter > 0, inter / (aw * ah + bw * bh - inter)).otherwise(0.0)


def contains(x: Column, y: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Is the point in the box, edges included?"""
    return x.between(bx, bx + bw) & y.between(by, by + bh)


def contain_fit(width: Column, height: Column, page_w: float, page_h: float) -> Column:
    """struct<w,h,x,y>: the image at its aspect, as large as the page allows, centred."""
    aspect = width / height
    wide = aspect > page_w / page_h
    w = F.when(wide, F.lit(float(page_w))).otherwise(page_h * aspect)
    h = F.when(wide, page_w / aspect).otherwise(F.lit(float(page_h)))
    return F.struct(w.alias("w"), h.alias("h"), ((page_w - w) / 2).alias("x"), ((page_h - h) / 2).alias("y"))


def homography_apply(m: Column, x: Column, y: Column) -> Column:
    """Point through a row-major 3x3 matrix held in an array of 9."""
    g = lambda i: F.element_at(m, i + 1)
    d = g(6) * x + g(7) * y + g(8)
    return point((g(0) * x + g(1) * y + g(2)) / d, (g(3) * x + g(4) * y + g(5)) / d)
