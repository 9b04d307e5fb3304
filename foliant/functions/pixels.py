"""Grey images as columns: warp, crop, letterbox and normalisation in the JVM. An image is struct<pixels array<double>, width int, height int>, row by row.

For thumbnails and small images, whose pixels are columns already; whole camera frames go through the numpy operators in ``operators.images``,
which these agree with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image(pixels: Column, width: Column | int, height: Column | int) -> Column:
    """A struct<pixels, width, height> of a pixel array."""
    of = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(pixels.cast("array<double>").alias("pixels"), of(width).alias("width"), of(height).alias("height"))


def _at(img: Column, x: Column, y: Column) -> Column:
    """One pixel by whole numbers; outside the image 0."""
    inside = (x >= 0) & (y >= 0) & (x < img["width"]) & (y < img["height"])
    return F.when(inside, F.get(img["pixels"], (y * img["width"] + x).cast("int"))).otherwise(F.lit(0.0))


def sample(img: Column, x: Column, y: Column) -> Column:
    """Bilinear; outside the image is 0."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    top = _at(img, x0, y0) * (1 - fx) + _at(img, x0 + 1, y0) * fx
    low = _at(img, x0, y0 + 1) * (1 - fx) + _at(img, x0 + 1, y0 + 1) * fx
    return top * (1 - fy) + low * fy


def square_to_quad(quad: list[tuple[Column, Column]]) -> Column:
    """The projective map of the unit square to tl, tr, br, bl, as struct<a,b,c,d,e,f,g,h>: x = (a u + b v + c) / (g u + h v + 1), and y with d, e, f. It is
    what elimination of the eight equations gives; null where three corners lie on a line through br."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    ux, vx, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    uy, vy, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    den = F.nullif(ux * vy - vx * uy, F.lit(0.0))
    g, h = (sx * vy - vx * sy) / den, (ux * sy - sx * uy) / den
    values = x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, "abcdefgh")])


def warp(img: Column, m: Column, width: int, height: int) -> Column:
    """The quad's content (``m``: its map from the unit square) as a width x height image of levels from 0 to 255."""

    def pixel(i: Column) -> Column:
        u, v = (i % width) / F.lit(float(width)), F.floor(i / width) / F.lit(float(height))
        w = m["g"] * u + m["h"] * v + 1
        return level(sample(img, (m["a"] * u + m["b"] * v + m["c"]) / w, (m["d"] * u + m["e"] * v + m["f"]) / w))

    return image(F.when(m["g"].isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)), width, height)


def level(v: Column) -> Column:
    """The nearest level (half to even) from 0 to 255."""
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0))


def crop(img: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies in the image; nothing of it gives an empty image."""
    x1, y1 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    w, h = (F.greatest(F.least(a + n, side) - b, F.lit(0)).cast("int") for a, n, side, b in ((x, width, img["width"], x1), (y, height, img["height"], y1)))
    rows = F.when((w > 0) & (h > 0), F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice(img["pixels"], ((y1 + r) * img["width"] + x1 + 1).cast("int"), w))))
    return image(F.coalesce(rows, F.array().cast("array<double>")), w, h)


def letterbox(img: Column, side: int) -> Column:
    """Scaled by its longer side into the top left of a black square; an empty image gives a black square."""
    scale = F.lit(float(side)) / F.greatest(img["width"], img["height"])
    w, h = (F.greatest(F.rint(img[n] * scale), F.lit(1.0)) for n in ("width", "height"))

    def pixel(i: Column) -> Column:
        gx, gy = i % side, F.floor(i / side)
        clip = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), (img[n] - 1).cast("double"))
        x, y = clip((gx + 0.5) * img["width"] / w - 0.5, "width"), clip((gy + 0.5) * img["height"] / h - 0.5, "height")
        return F.when((gx < w) & (gy < h) & (img["width"] > 0) & (img["height"] > 0), sample(img, x, y)).otherwise(F.lit(0.0))

    return image(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel), side, side)


def normalised(img: Column, mean: float, std: float) -> Column:
    return image(F.transform(img["pixels"], lambda v: (v - mean) / std), img["width"], img["height"])


def turned(img: Column) -> Column:
    """A quarter to the left."""
    w, h = img["width"], img["height"]
    pixel = lambda i: F.get(img["pixels"], ((i % h) * w + (w - 1 - F.floor(i / h))).cast("int"))
    return image(F.when((w > 0) & (h > 0), F.transform(F.sequence(F.lit(0), w * h - 1), pixel)).otherwise(img["pixels"]), h, w)
