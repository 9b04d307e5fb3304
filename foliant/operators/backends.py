"""Pluggable model backends: made and warmed up once for each task, fed by Arrow batches of images, disposed of at the end.

A backend is any object that has the method named below; ``warm_up()`` and ``dispose()`` are called where it has them. ``make`` builds
one in the worker. Images are (height, width, 3) arrays of bytes; frames have pixels, width, height and channels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.evaluate import quality
from foliant.operators.images import QUAD, image_of
from foliant.shipping import ship

SIZED = "width > 0 AND height > 0 AND pixels IS NOT NULL"
LAYOUT = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,class_id:int,char_count:int>>"
Make = Callable[[], Any]


def answered(frames: DataFrame, make: Make, call: Callable[[Any, np.ndarray], Any], name: str, kind: str | T.DataType) -> DataFrame:
    """frames with ``name``: what ``call(backend, image)`` says of each. Frames without pixels or a size go before any backend is made."""
    ship(frames.sparkSession)
    rest = [f for f in frames.schema.fields if f.name != name]
    kind = T.StructType.fromDDL(f"v {kind}")["v"].dataType if isinstance(kind, str) else kind
    schema = T.StructType([*rest, T.StructField(name, kind)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        getattr(backend, "warm_up", lambda: None)()
        try:
            for pdf in parts:
                yield pdf.assign(**{name: [call(backend, image_of(r.pixels, r.width, r.height, r.channels)) for r in pdf.itertuples()]})
        finally:
            getattr(backend, "dispose", lambda: None)()

    return frames.select(*[f.name for f in rest]).filter(SIZED).mapInPandas(run, schema)


def detect_edges(frames: DataFrame, make: Make) -> DataFrame:
    """frames with quad from ``detect(image)``: four corners (tl, tr, br, bl) as (x, y), or None."""

    def call(backend: Any, image: np.ndarray) -> dict | None:
        quad = backend.detect(image)
        return None if quad is None else {n: {"x": float(x), "y": float(y)} for n, (x, y) in zip(("tl", "tr", "br", "bl"), quad)}

    return answered(frames, make, call, "quad", QUAD)


def score_quality(frames: DataFrame, make: Make) -> DataFrame:
    """frames with quality: blur, glare and occlusion from ``score(image)`` and their overall value."""
    call = lambda backend, image: dict(zip(("blur", "glare", "occlusion"), map(float, backend.score(image))))
    scored = answered(frames, make, call, "quality", "struct<blur:double,glare:double,occlusion:double>")
    q = F.col("quality")
    return scored.withColumn("quality", q.withField("overall", quality(q["blur"], q["glare"], q["occlusion"])))


def classify(frames: DataFrame, make: Make) -> DataFrame:
    """frames with is_document, reason and confidence from ``classify(image)``: (bool, text or None, number)."""
    call = lambda backend, image: dict(zip(("is_document", "reason", "confidence"), backend.classify(image)))
    said = answered(frames, make, call, "_said", "struct<is_document:boolean,reason:string,confidence:double>")
    return said.withColumns({k: F.col("_said")[k] for k in ("is_document", "reason", "confidence")}).drop("_said")


def detect_layout(frames: DataFrame, make: Make) -> DataFrame:
    """One row for each raw detection from ``detect(image)``: (x1, y1, x2, y2, score, class_id, char_count) in the model's square, ``box`` numbering a
    frame's; with the frame's size as img_w, img_h and its other columns but the pixels."""
    names = ("x1", "y1", "x2", "y2", "score", "class_id", "char_count")

    def call(backend: Any, image: np.ndarray) -> list[dict]:
        return [dict(zip(names, (*map(float, b[:5]), int(b[5]), int(b[6]) if len(b) > 6 else 100))) for b in backend.detect(image)]

    found = answered(frames, make, call, "_boxes", LAYOUT).withColumnsRenamed({"width": "img_w", "height": "img_h"}).drop("pixels", "channels")
    return found.select("*", F.posexplode("_boxes").alias("box", "b")).select("*", "b.*").drop("_boxes", "b")


def recognise(crops: DataFrame, make: Make) -> DataFrame:
    """crops with text and confidence from ``recognise(image)``; a crop at which the backend fails has no text and confidence 0."""

    def call(backend: Any, image: np.ndarray) -> dict:
        try:
            text, confidence = backend.recognise(image)
            return {"text": str(text), "confidence": float(confidence)}
        except Exception:  # the contract: a line that can't be read is empty
            return {"text": "", "confidence": 0.0}

    said = answered(crops, make, call, "_said", "struct<text:string,confidence:double>")
    return said.withColumns({k: F.col("_said")[k] for k in ("text", "confidence")}).drop("_said")
