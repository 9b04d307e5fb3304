"""A sink of files: rows become PDF, zip or plain files, page by page, and show only when the whole job has succeeded.

Each attempt at a task writes to a folder of its own under ``_attempts``; its files move to their places when the job commits. Whatever
attempts failed, were repeated or came too late leaves with that folder. A manifest for each job (``_files-<job>.json``, written aside
and moved) names what it added. ``overwrite`` takes away what earlier manifests name and this job did not write anew; ``append`` leaves it, and
a file of the same name is replaced.

The names of an attempt's files lie beside them, not in its message, and the commit takes them name by name: of the files of a job the driver
holds 8 bytes each, to see that no two have the same name. (``overwrite`` holds the names, old and new.)

A file is one stream of bytes, so its rows come to one task in order; the task holds one page at a time and, for PDF, the place of each object.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from foliant.shipping import ship

NAME = "capture_files"
ATTEMPTS, NAMES = "_attempts", "_names"
POINTS = 72 / 25.4
#: Columns of a row by kind of file, after ``file`` and ``part``; ``part`` gives the order.
COLUMNS = {"raw": ("content",), "zip": ("name", "content"), "pdf": ("content", "width", "height", "w", "h", "x", "y", "page_w", "page_h")}


class Raw:
    """Contents one after the other."""

    def __init__(self, out) -> None:
        self.out = out

    def add(self, row: dict) -> None:
        self.out.write(row["content"] or b"")

    def close(self) -> None:
        pass


class Zip:
    def __init__(self, out) -> None:
        self.zip = zipfile.ZipFile(_Told(out), "w", zipfile.ZIP_DEFLATED)

    def add(self, row: dict) -> None:
        self.zip.writestr(zipfile.ZipInfo(row["name"], (1980, 1, 1, 0, 0, 0)), row["content"] or b"", zipfile.ZIP_DEFLATED)

    def close(self) -> None:
        self.zip.close()


class _Told:
    """A stream that can only be written to, for writers that ask where they are."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class Pdf:
    """A JPEG a page, at w, h, x, y in millimetres from the top left of a page of page_w by page_h."""

    def __init__(self, out) -> None:
        self.out = _Told(out)
        self.out.write(b"%PDF-1.4\n")
        self.places: dict[int, int] = {}
        self.pages: list[int] = []

    def put(self, number: int, *body: bytes) -> None:
        self.places[number] = self.out.at
        self.out.write(b"%d 0 obj\n" % number)
        for piece in body:
            self.out.write(piece)
        self.out.write(b"\nendobj\n")

    def add(self, row: dict) -> None:
        n = 3 + 3 * len(self.pages)
        self.pages.append(n)
        w, h, x, y, page_w, page_h = (row[k] * POINTS for k in ("w", "h", "x", "y", "page_w", "page_h"))
        draw = b"q %.3f 0 0 %.3f %.3f %.3f cm /I Do Q" % (w, h, x, page_h - y - h)
        self.put(n, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (page_w, page_h, n + 2, n + 1))
        self.put(n + 1, b"<< /Length %d >>\nstream\n" % len(draw), draw, b"\nendstream")
        image = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n"
        self.put(n + 2, image % (row["width"], row["height"], len(row["content"])), row["content"], b"\nendstream")

    def close(self) -> None:
        self.put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        self.put(2, b"<< /Type /Pages /Count %d /Kids [" % len(self.pages), *(b"%d 0 R " % n for n in self.pages), b"] >>")
        start, many = self.out.at, len(self.places) + 1
        self.out.write(b"xref\n0 %d\n0000000000 65535 f \n" % many)
        for n in range(1, many):
            self.out.write(b"%010d 00000 n \n" % self.places[n])
        self.out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (many, start))


KINDS = {"raw": Raw, "zip": Zip, "pdf": Pdf}


def safe(name: str | None) -> str:
    """A relative name below the folder; anything else raises."""
    if not name or name.startswith(("/", "_", ".")) or re.search(r"(^|/)\.\.?(/|$)|//|/$", name):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Made(WriterCommitMessage):
    folder: str
    many: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "raw"), overwrite
        self.job = uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {self.kind}")

    def place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        fs, root = self.place()
        folder = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        done: dict[str, None] = {}
        now, out, file = None, None, None

        def close() -> None:
            if file is not None:
                file.close()
                out.close()

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):  # a page at a time, never a batch of them as objects
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                if row["file"] != now:
                    close()
                    now = safe(row["file"])
                    if now in done:
                        raise ValueError(f"the rows of {now} don't follow each other")
                    done[now] = None
                    fs.create_dir(f"{folder}/{now}".rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{folder}/{now}", compression=None)
                    file = KINDS[self.kind](out)
                file.add(row)
        close()
        if done:
            with fs.open_output_stream(f"{folder}/{NAMES}", compression=None) as f:
                for name in done:
                    f.write(json.dumps(name).encode() + b"\n")
        return Made(folder, len(done))

    def commit(self, messages: list[Made | None]) -> None:
        fs, root = self.place()
        if self.twice(messages):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name")
        old = manifests(fs, root) if self.overwrite else {}
        fs.create_dir(f"{root}/{ATTEMPTS}/{self.job}", recursive=True)
        aside, last = f"{root}/{ATTEMPTS}/{self.job}/manifest", None
        with fs.open_output_stream(aside, compression=None) as f:
            f.write(b"[")
            for k, (folder, name) in enumerate(self.made(messages)):
                if (at := f"{root}/{name}".rpartition("/")[0]) != last:
                    fs.create_dir(last := at, recursive=True)
                fs.move(f"{folder}/{name}", f"{root}/{name}")
                f.write(b",\n" * bool(k) + json.dumps(name).encode())
            f.write(b"]")
        fs.move(aside, f"{root}/_files-{self.job}.json")
        if self.overwrite:
            new = {name for _, name in self.made(messages)}
            for manifest, names in old.items():
                for name in set(names) - new:
                    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                        fs.delete_file(f"{root}/{name}")
                fs.delete_file(manifest)
        fs.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")

    def made(self, messages: list[Made | None]) -> Iterator[tuple[str, str]]:
        """(attempt's folder, name) of each file, as the attempts wrote them down."""
        fs, _ = self.place()
        for m in messages:
            if m is not None and m.many:
                with fs.open_input_stream(f"{m.folder}/{NAMES}", compression=None) as f:
                    for line in io.BufferedReader(f):
                        yield m.folder, json.loads(line)

    def twice(self, messages: list[Made | None]) -> bool:
        """Whether two files have the same name: numbers of 64 bits for all names, the names themselves where numbers are equal."""
        number = lambda name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())
        held = np.asarray(array("Q", (number(name) for _, name in self.made(messages))))
        held.sort()
        again = set(held[1:][held[1:] == held[:-1]].tolist())
        same = [name for _, name in self.made(messages) if number(name) in again] if again else []
        return len(set(same)) < len(same)

    def abort(self, messages: list[Made | None]) -> None:
        fs, root = self.place()
        if fs.get_file_info(f"{root}/{ATTEMPTS}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")


def manifests(fs: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    """The manifests of a folder with the files that they name."""
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if re.fullmatch(r"_files-\w+\.json", info.base_name):
            with fs.open_input_stream(info.path) as f:
                found[info.path] = json.load(f)
    return found


class CaptureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, part long, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        options = dict(self.options)
        missing = {"file", "part", *COLUMNS[options.get("kind", "raw")]} - set(schema.names)
        if missing:
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        return FileWriter(options, overwrite)


def write_files(rows: DataFrame, path: str, kind: str = "raw", mode: str = "append") -> None:
    """rows (file, part and the columns of the kind) as files below ``path``."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(CaptureFiles)
    held = rows.select("file", "part", *COLUMNS[kind]).repartition("file").sortWithinPartitions("file", "part")
    held.write.format(NAME).mode(mode).option("kind", kind).save(path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes (length) of all files that the manifests of a folder name."""
    fs, root = pafs.FileSystem.from_uri(path.rstrip("/"))
    names = sorted({n for names in manifests(fs, root).values() for n in names})
    sizes = [(n, fs.get_file_info(f"{root}/{n}").size) for n in names]
    return spark.createDataFrame(sizes, "file string, bytes long")


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, name, bytes (unpacked), crc of every entry of the zip files that the manifests name; only their directories are read."""
    ship(spark)
    listed = written(spark, path).filter(F.lower("file").endswith(".zip")).select("file")
    top = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(f"{top}/{name}")
                with fs.open_input_file(at) as f:
                    held = zipfile.ZipFile(f).infolist()
                cols = [name] * len(held), [x.filename for x in held], [x.file_size for x in held], [x.CRC for x in held]
                kinds = pa.string(), pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "name", "bytes", "crc"])

    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "file string, name string, bytes long, crc long")


def pdf_rows(pages: DataFrame, page_size: str = "A4", mode: str = "single", size: int = 10) -> DataFrame:
    """Rows for ``kind`` pdf from pages (session, position, jpeg, width, height): ``<session>/document-001.pdf`` and on."""
    from foliant.operators.export import SIZES, layout

    laid = layout(pages, page_size, mode, size)
    page = [F.lit(v) for v in SIZES[page_size]] if page_size in SIZES else [F.col("width").cast("double"), F.col("height").cast("double")]
    name = F.concat(F.col("session").cast("string"), F.lit("/document-"), F.lpad((F.col("file_no") + 1).cast("string"), 3, "0"), F.lit(".pdf"))
    return laid.select(name.alias("file"), F.col("position").cast("long").alias("part"), F.col("jpeg").alias("content"), "width", "height", "w", "h", "x", "y", page[0].alias("page_w"), page[1].alias("page_h"))
