"""PDF export: page layout as columns, and a small writer that embeds JPEG bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import contain_fit
from foliant.operators.pages import batch_key

#: Page sizes in millimetres.
SIZES = {"A4": (210.0, 297.0), "Letter": (215.9, 279.4)}
POINTS = 72 / 25.4


def layout(pages: DataFrame, page_size: str = "A4", mode: str = "single", size: int = 10) -> DataFrame:
    """pages with file_no and w, h, x, y in millimetres. ``auto`` takes the image's own size."""
    if page_size == "auto":
        fit = F.struct(F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    else:
        fit = contain_fit(F.col("width"), F.col("height"), *SIZES[page_size])
    return pages.withColumn("file_no", batch_key(mode, F.col("position"), size)).withColumn("_f", fit).select("*", "_f.*").drop("_f")


def pdf_bytes(pages: list[dict], page_w: float, page_h: float) -> bytes:
    """One PDF: for each page the JPEG (jpeg, width, height) at w, h, x, y in millimetres from the top left."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for p in pages:
        first = len(objects) + 1
        kids.append(f"{first} 0 R")
        w, h, x, y = (p[k] * POINTS for k in ("w", "h", "x", "y"))
        draw = f"q {w:.3f} 0 0 {h:.3f} {x:.3f} {page_h * POINTS - y - h:.3f} cm /I Do Q".encode()
        objects += [
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {page_w * POINTS:.3f} {page_h * POINTS:.3f}] /Resources << /XObject << /I {first + 2} 0 R >> >> /Contents {first + 1} 0 R >>".encode(),
            b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw),
            b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream"
            % (p["width"], p["height"], len(p["jpeg"]), p["jpeg"]),
        ]
    objects[1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(kids)}] >>".encode()
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (i, body))
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
    return out.getvalue()


def export(pages: DataFrame, page_size: str = "A4", mode: str = "single", size: int = 10) -> DataFrame:
    """session, file_no, pages, pdf (bytes): one file for each batch of each session, written by its own task.

    pages: session, position, jpeg, width, height. A session is bounded by its page cap.
    """
    page_w, page_h = SIZES.get(page_size, (0.0, 0.0))
    kind = pages.schema["session"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("position").to_dict("records")
        w, h = (page_w, page_h) if page_w else (rows[0]["width"], rows[0]["height"])
        return pd.DataFrame({"session": [rows[0]["session"]], "file_no": [rows[0]["file_no"]], "pages": [len(rows)], "pdf": [pdf_bytes(rows, w, h)]})

    return layout(pages, page_size, mode, size).groupBy("session", "file_no").applyInPandas(one, f"session {kind}, file_no int, pages int, pdf binary")


def archive(files: Iterator[tuple[str, bytes]]) -> bytes:
    """A zip of named files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def archives(exported: DataFrame) -> DataFrame:
    """session, zip: all files of a session, named document-001.pdf and on."""
    kind = exported.schema["session"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("file_no")
        made = archive((f"document-{n + 1:03d}.pdf", data) for n, data in zip(rows["file_no"], rows["pdf"]))
        return pd.DataFrame({"session": [rows["session"].iloc[0]], "zip": [made]})

    return exported.groupBy("session").applyInPandas(one, f"session {kind}, zip binary")
