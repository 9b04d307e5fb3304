"""Decoding of recognised lines in Arrow batches, and gates on what models return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.shipping import ship

#: Ids below this are skipped in the Japanese code, and its stop id.
FIRST_CLASS, STOP = 4, 0
#: Fixed value: recognised lines below this confidence are dropped.
MIN_CONFIDENCE = 0.3


def decode(df: DataFrame, ids: str, probabilities: str, charset: str, european: bool = False) -> DataFrame:
    """df without its token arrays, with decoded (text) and confidence (mean probability of what stays, 0 without any).

    Class ids count up to the stop: id 0 in the Japanese code, where ids under 4 are skipped and others mean class id - 1; the charset's size in
    the European one. Ids outside the charset go, then ids equal to the one kept before. A null array decodes to an empty text.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c not in (ids, probabilities, "decoded", "confidence")]
    picked = df.select(*rest, ids, probabilities)
    points = np.array([ord(c) for c in charset], np.uint32)
    shift, stop, least = (0, len(charset), 0) if european else (1, STOP, FIRST_CLASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = batch.column(len(rest)), batch.column(len(rest) + 1)
            sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            w = p.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            stops = np.flatnonzero(x == stop)
            first = np.full(len(sizes), len(x))
            np.minimum.at(first, row[stops], stops)
            keep = np.flatnonzero((np.arange(len(x)) < first[row]) & (x >= least) & (x - shift >= 0) & (x - shift < len(points)))
            x, w, row = x[keep] - shift, w[keep], row[keep]
            new = np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (row[1:] != row[:-1])])
            x, w, row = x[new], w[new], row[new]
            n = np.bincount(row, minlength=len(sizes))
            text = points[x].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.cumsum(n).tolist()
            mean = np.bincount(row, weights=w, minlength=len(sizes)) / np.maximum(n, 1)
            decoded = pa.array([text[a:b] for a, b in zip([0, *ends], ends)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], decoded, pa.array(mean)], [*rest, "decoded", "confidence"])

    return picked.mapInArrow(run, picked.select(*rest).schema.add("decoded", "string").add("confidence", "double"))


def confident(lines: DataFrame, confidence: str = "confidence", least: float = MIN_CONFIDENCE) -> DataFrame:
    """Lines recognised with ``least`` confidence or more; unknown confidence goes."""
    return lines.filter(F.col(confidence) >= least)


def classified(pages: DataFrame, is_document: str = "is_document", reason: str = "reason") -> DataFrame:
    """Every page with ``accepted`` and, where it is rejected, why: ``not-a-document`` unless the classifier gave a reason; a null answer rejects."""
    ok = F.coalesce(F.col(is_document), F.lit(False))
    known = F.col(reason) if reason in pages.columns else F.lit(None).cast("string")
    return pages.withColumns({"accepted": ok, reason: F.when(~ok, F.coalesce(known, F.lit("not-a-document")))})


def line_summary(lines: Column, duration_ms: Column) -> dict[str, Column]:
    """What a result panel shows: the number of lines, and the duration in whole milliseconds, halves rounded up."""
    return {"line_count": F.greatest(F.size(lines), F.lit(0)), "duration": F.floor(duration_ms + 0.5).cast("long")}


def cascade(lines: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], route: str = "model") -> DataFrame:
    """Lines by the model that they are routed to, each branch through its own function of ``models`` (name to a DataFrame function); union of all."""
    out = None
    for name, recognise in models.items():
        part = recognise(lines.filter(F.col(route) == name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no models")
    return out
