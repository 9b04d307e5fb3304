"""Pixel operators in numpy, run as vectorised Python functions over image columns (row-major arrays or bytes).

There is no vision library here; contours and their smallest rectangles are in ``contours``. Parity with other libraries is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import contours
from foliant.shipping import ship

#: Normalisation in 0..255, and for recognition in 0..1.
IMAGENET_MEAN, IMAGENET_STD = (123.675, 116.28, 103.53), (58.395, 57.12, 57.375)
EUROPEAN_MEAN, EUROPEAN_STD = (0.694, 0.695, 0.693), (0.299, 0.296, 0.301)
MORPH = 15


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., :3] @ [0.299, 0.587, 0.114]).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The level that separates best; pixels above it are foreground."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    n, total = hist.cumsum(), (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total[-1] * n - total * n[-1]) ** 2 / (n * (n[-1] - n))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _slide(a: np.ndarray, size: int, take, fill: int) -> np.ndarray:
    r = size // 2
    for axis in (0, 1):
        pad = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        a = take(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), size, axis), -1)
    return a


def dilate(a: np.ndarray, size: int = MORPH) -> np.ndarray:
    return _slide(a, size, np.max, 0)


def erode(a: np.ndarray, size: int = MORPH) -> np.ndarray:
    return _slide(a, size, np.min, 1)


def close_open(mask: np.ndarray, size: int = MORPH) -> np.ndarray:
    closed = erode(dilate(mask, size), size)
    return dilate(erode(closed, size), size)


def order_corners(pts: np.ndarray) -> np.ndarray:
    """tl, tr, br, bl; the first of equal points wins."""
    total, across = pts.sum(1), pts[:, 1] - pts[:, 0]
    return pts[[total.argmin(), across.argmin(), total.argmax(), across.argmax()]]


def detect_quad(gray: np.ndarray, low: float = 0.15, high: float = 0.97) -> np.ndarray | None:
    """The paper's corners, or None: Otsu, closing and opening, the outer contour of largest area in the gate, its smallest rectangle."""
    best = contours.largest(close_open((gray > otsu(gray)).astype(np.int64)), low, high)
    if best is None:
        return None
    cx, cy, w, h, deg = contours.callipers(best)
    c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
    half = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    return order_corners(half @ np.array([[c, s], [-s, c]]) + [cx, cy])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3x3 matrix that takes four points to four points."""
    rows = [r for (x, y), (u, v) in zip(src, dst) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(dst, float).ravel()), 1).reshape(3, 3)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples; outside the image is 0."""
    img = np.atleast_3d(image).astype(float)
    h, w = img.shape[:2]
    padded = np.pad(img, ((1, 2), (1, 2), (0, 0)))
    x, y = np.clip(x, -1, w) + 1, np.clip(y, -1, h) + 1
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return (top * (1 - fy) + low * fy).reshape(x.shape + image.shape[2:])


def warp(image: np.ndarray, quad: np.ndarray, width: int = 1200, height: int = 1600) -> np.ndarray:
    """The quad's content as a width x height image."""
    target = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
    back = homography(target, quad)
    gx, gy = np.meshgrid(np.arange(width), np.arange(height))
    p = np.stack([gx, gy, np.ones_like(gx)], -1) @ back.T
    return np.clip(np.rint(bilinear(image, p[..., 0] / p[..., 2], p[..., 1] / p[..., 2])), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    gx, gy = np.meshgrid((np.arange(width) + 0.5) * w / width - 0.5, (np.arange(height) + 0.5) * h / height - 0.5)
    return bilinear(image, np.clip(gx, 0, w - 1), np.clip(gy, 0, h - 1))


def letterbox(image: np.ndarray, side: int = 800) -> np.ndarray:
    """Scaled by its longer side into the top left of a black square."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    out = np.zeros((side, side, *image.shape[2:]))
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    out[:nh, :nw] = resize(image, nw, nh)
    return out


def layout_tensor(rgb: np.ndarray, side: int = 800) -> np.ndarray:
    """float32 [1, 3, side, side], normalised."""
    return ((letterbox(rgb, side) - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1)[None].astype(np.float32)


def line_tensor(rgb: np.ndarray, width: int, height: int, european: bool = False) -> np.ndarray:
    """float32 [1, 3, height, width] of a line; upright lines are turned a quarter to the left first."""
    if rgb.shape[0] > rgb.shape[1]:
        rgb = np.rot90(rgb)
    x = resize(rgb, width, height) / 255
    x = (x - EUROPEAN_MEAN) / EUROPEAN_STD if european else 2 * (x - 0.5)
    return x.transpose(2, 0, 1)[None].astype(np.float32)


def crop(rgb: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return rgb[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def crops(rgb: np.ndarray, boxes: np.ndarray) -> list[np.ndarray]:
    return [crop(rgb, *map(int, b)) for b in boxes]


def thumbnail(rgb: np.ndarray, side: int = 16) -> np.ndarray:
    """side x side luminance (Rec. 709) by area means."""
    gray = rgb[..., :3] @ [0.2126, 0.7152, 0.0722]
    rows, cols = (np.array_split(np.arange(n), side) for n in gray.shape)
    return np.array([[gray[r[0] : r[-1] + 1, c[0] : c[-1] + 1].mean() for c in cols] for r in rows])


# -- over DataFrames: frames have pixels (binary, 8-bit), width, height and channels --------------


def image_of(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    img = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return img if channels > 1 else np.repeat(img, 3, 2)


POINT = T.StructType([T.StructField(k, T.DoubleType()) for k in "xy"])
QUAD = T.StructType([T.StructField(k, POINT) for k in ("tl", "tr", "br", "bl")])


def _with(frames: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*frames.schema.fields, T.StructField(name, kind)])


def detect(frames: DataFrame) -> DataFrame:
    """frames with quad, null where no paper is found; frames without size are dropped before any pixel is read."""
    ship(frames.sparkSession)
    schema = _with(frames, "quad", QUAD)
    names = ("tl", "tr", "br", "bl")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            quads = [detect_quad(to_gray(image_of(r.pixels, r.width, r.height, r.channels))) for r in pdf.itertuples()]
            yield pdf.assign(quad=[None if q is None else {n: {"x": float(x), "y": float(y)} for n, (x, y) in zip(names, q)} for q in quads])

    return frames.filter("width > 0 AND height > 0 AND pixels IS NOT NULL").mapInPandas(run, schema)


def rectify(frames: DataFrame, width: int = 1200, height: int = 1600) -> DataFrame:
    """Frames with a quad, warped to width x height, three channels."""
    ship(frames.sparkSession)
    schema = frames.drop("quad").schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [_flat(r, width, height).tobytes() for r in pdf.itertuples()]
            yield pdf.drop(columns="quad").assign(pixels=out, width=width, height=height, channels=3)

    return frames.filter("quad IS NOT NULL").mapInPandas(run, schema)


def _flat(frame: Any, width: int, height: int) -> np.ndarray:
    quad = np.array([[frame.quad[k]["x"], frame.quad[k]["y"]] for k in ("tl", "tr", "br", "bl")])
    return warp(image_of(frame.pixels, frame.width, frame.height, frame.channels), quad, width, height)


def rectified_thumbnails(frames: DataFrame, width: int = 1200, height: int = 1600, side: int = 16) -> DataFrame:
    """luma of ``thumbnails`` over ``rectify``, with the frames' other columns; the pixels of a page are never handed back."""
    ship(frames.sparkSession)
    rest = [f for f in frames.schema.fields if f.name not in ("quad", "pixels", "width", "height", "channels")]
    schema = T.StructType([*rest, T.StructField("luma", T.ArrayType(T.DoubleType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            luma = [thumbnail(_flat(r, width, height).astype(float), side).ravel() for r in pdf.itertuples()]
            yield pdf[[f.name for f in rest]].assign(luma=luma)

    return frames.filter("quad IS NOT NULL").mapInPandas(run, schema)


def thumbnails(frames: DataFrame, side: int = 16) -> DataFrame:
    """frames with luma: side * side doubles."""
    ship(frames.sparkSession)
    schema = _with(frames, "luma", T.ArrayType(T.DoubleType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(luma=[thumbnail(image_of(r.pixels, r.width, r.height, r.channels).astype(float), side).ravel() for r in pdf.itertuples()])

    return frames.mapInPandas(run, schema)


def sharpness(pixels: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored."""
    p = np.pad(pixels.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def readable(frames: DataFrame) -> DataFrame:
    """Frames that are ready: decoded far enough and with a size."""
    return frames.filter((F.col("ready_state") >= 2) & (F.col("width") > 0))
