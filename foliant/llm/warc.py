"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions over files (small files share one), takes predicates on the record type
and on header columns from Spark, parses a record's header first, and neither decompresses nor
keeps a payload that a predicate or ``payload=false`` makes unwanted. Members written here carry their compressed length in gzip's
extra field, so the next record is found by seeking. Archives of other writers are read too: in plain ones the next record is found by
seeking, and members compressed without that field are inflated piece by piece to find their end, and the pieces thrown away.

Writing gives each task attempt files of its own, which count only once the driver has committed a
manifest of them: files of lost executors or of second attempts are never read. The folder has to be one that all
machines share.

Defined results: a null payload is written as an empty one; a null URL leaves its header out and reads as null; control
characters in a URL are percent-encoded; ids are written as text (percent-encoded) and read back as text, a null id as null; records are
read whole, however long; a damaged file raises with its name and offset; no rows give no records; columns of other names are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from foliant.llm.common import discard, parts, shared_path, staged, table, text_of
from foliant.shipping import ship

NAME = "foliant_warc"
#: Every commit writes a manifest of its own: the files that it added.
MANIFEST = re.compile(r"_manifest(-\w+)?\.json")
STEP = 1 << 16
#: Bits of a bitmap of keys: 8 MB, and 17 MB as the table of words that is broadcast.
MARKS = 1 << 26
BIT = "shiftleft(1L, CAST({} & 63 AS INT))"
READ_SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, content_length long, http_length long, headers map<string,string>, payload binary"
)
#: Columns that a header gives, by the header's name; fixed values of the format.
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARROW = pa.schema([
    *[(n, t) for n, t in (("file", pa.string()), ("offset", pa.int64()))],
    *[(n, pa.string()) for n in HEADER_OF],
    ("content_length", pa.int64()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


# -- one record -------------------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, length: int, refers_to: str | None, date: str) -> bytes:
    """A response or revisit record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose extra field "sl" tells the member's length and that of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    fits = total < 1 << 32 and len(data) < 1 << 32
    extra = struct.pack("<2sHII", b"sl", 8, total if fits else 0, len(data) if fits else 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_header(head: bytes) -> dict[str, str]:
    """Header names in lower case to values; folded lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


# -- a file -----------------------------------------------------------------------------------


class Window:
    """Reads of a file through one buffer, so that parsing a header costs no read of its own."""

    def __init__(self, file: pa.NativeFile, step: int = 1 << 20):
        self.file, self.step, self.size = file, step, file.size()
        self.start, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        i = offset - self.start
        if i < 0 or i + n > len(self.held):
            self.file.seek(min(offset, self.size))
            self.start, self.held, i = offset, self.file.read(max(n, self.step)), 0
        return self.held[i : i + n]


class Content:
    """A record's bytes from an offset of a file, unpacked only as far as they are asked for."""

    def __init__(self, window: Window, offset: int):
        self.w, self.offset, self.got, self.read = window, offset, bytearray(), 0
        first = window.at(offset, 24)
        self.packed = first[:2] == b"\x1f\x8b"
        self.total = 0
        if self.packed:
            self.z = zlib.decompressobj(31)
            if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
                self.total = struct.unpack("<I", first[16:20])[0]

    def piece(self, most: int) -> bytes | None:
        """The next bytes of a packed member, ``most`` at most; None at the end of the file."""
        raw = self.z.unconsumed_tail
        if not raw:
            step = min(STEP, self.total - self.read) if self.total else STEP
            raw = self.w.at(self.offset + self.read, step)
            self.read += len(raw)
        return self.z.decompress(raw, most) if raw else None

    def upto(self, n: int) -> bytes:
        """The first n bytes, or all if there are fewer."""
        while len(self.got) < n and not (self.packed and self.z.eof):
            want = max(n - len(self.got), 4096)
            more = self.piece(want) if self.packed else self.w.at(self.offset + len(self.got), want)
            if more is None or not self.packed and not more:
                break
            self.got += more
        return bytes(memoryview(self.got)[:n])

    def after(self, length: int) -> int:
        """Offset of what follows this record, whose content has ``length`` bytes. Nothing that is passed over is kept."""
        if not self.packed:
            return self.offset + length
        if self.total:
            return self.offset + self.total
        while not self.z.eof:
            if self.piece(STEP) is None:
                raise ValueError("member is cut short")
        return self.offset + self.read - len(self.z.unused_data)


def records(path: str, wanted: Callable[[dict[str, str | None]], bool], payloads: bool) -> Iterator[dict]:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        w = Window(f)
        at = 0
        while at < w.size:
            try:
                c = Content(w, at)
                n = 4096
                while (end := (head := c.upto(n)).find(b"\r\n\r\n")) < 0 and len(head) == n:
                    n *= 2
                if end < 0 or not head.startswith(b"WARC/"):
                    raise ValueError("no record header")
                headers = parse_header(head[:end])
                length = int(headers["content-length"])
                row: dict = {col: headers.get(h) for col, h in HEADER_OF.items()}
                if wanted(row):
                    row |= {"file": path, "offset": at, "content_length": length, "headers": list(headers.items()), "payload": None, "http_length": None}
                    body = end + 4
                    if headers.get("content-type", "").startswith("application/http"):
                        n = 4096
                        while (cut := (got := c.upto(body + min(n, length))[body:]).find(b"\r\n\r\n")) < 0 and n < length:
                            n *= 2
                        if cut >= 0:
                            http = parse_header(got[:cut])
                            row["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                            body += cut + 4
                    if payloads:
                        row["payload"] = c.upto(end + 4 + length)[body:]
                        if len(row["payload"]) != end + 4 + length - body:
                            raise ValueError("block is cut short")
                    yield row
                at = c.after(end + 4 + length + 4)
            except (ValueError, KeyError, zlib.error) as e:
                raise ValueError(f"{path}, offset {at}: {e}") from e


# -- the data source --------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payloads = options.get("payload", "true").lower() != "false"
        self.share = int(options.get("sharebytes", 64 << 20))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in HEADER_OF and isinstance(f, EqualTo):
                self.filters.append((name, "in", (f.value,)))
            elif name in HEADER_OF and isinstance(f, In):
                self.filters.append((name, "in", tuple(f.value)))
            elif name in HEADER_OF and isinstance(f, StringStartsWith):
                self.filters.append((name, "starts", f.value))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.filters.append((name, "known", None))
            else:
                yield f

    def wanted(self, row: dict[str, str | None]) -> bool:
        for name, how, value in self.filters:
            got = row[name]
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Files up to ``shareBytes`` together; a longer file is one partition."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        base = self.path.removesuffix(root)
        if info.type == pafs.FileType.File:
            return [Files((self.path,))]
        if committed := manifests(fs, root):
            found = [(f"{root}/{n}", size) for files in committed.values() for n, size in files]
        else:
            all_files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            found = [(x.path, x.size) for x in all_files if re.search(r"\.warc(\.gz)?$", x.path)]
        out, held, total = [], [], 0
        for path, size in sorted(found):
            if held and total + size > self.share:
                out.append(Files(tuple(held)))
                held, total = [], 0
            held.append(base + path)
            total += size
        return [*out, Files(tuple(held))]  # one without files where there are none

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for path in partition.paths:
            for row in records(path, self.wanted, self.payloads):
                held.append(row)
                total += len(row["payload"] or b"") + 1000
                if len(held) >= 512 or total > 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


def manifests(fs: pafs.FileSystem, root: str) -> dict[str, list]:
    """The manifests of a folder with the files (name, size) that each names."""
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if MANIFEST.fullmatch(info.base_name):
            with fs.open_input_stream(info.path) as f:
                out[info.path] = json.load(f)
    return out


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_type, record_id, target_uri, payload_digest, payload, http_length, refers_to."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.roll = int(options.get("rollbytes", 32 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in parts(batches):
            for r in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload"] or b"", r["http_length"], r["refers_to"], self.date))
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        before, name = manifests(fs, root) if self.overwrite else {}, uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/_{name}.tmp") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{root}/_{name}.tmp", f"{root}/_manifest-{name}.json")
        for manifest in before:  # first what names the files, so that no reader looks for one that went
            fs.delete_file(manifest)
        for old, _ in (f for held in before.values() for f in held):
            fs.delete_file(f"{root}/{old}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


# -- pages to archives and back ---------------------------------------------------------------


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("payload", str(payload).lower()).load(path)


def urn(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page.cast("string")), F.lit(">")), F.lit("<urn:page>"))


def page_of(record_id: Column) -> Column:
    """The page's id as text; null for a null id and for records of other writers."""
    return F.try_url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:page:([^>]*)>$", 1), F.lit("")))


def marks(df: DataFrame, *key: Column) -> DataFrame:
    """A bitmap of the keys' hashes: word, bits; at most ``MARKS / 64`` rows, whatever the number of keys."""
    at = df.select(F.pmod(F.xxhash64(*key), F.lit(MARKS)).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr(BIT.format("at"))).alias("bits"))


def marked(df: DataFrame, bitmap: DataFrame, name: str, *key: Column) -> DataFrame:
    """df with a flag that is true for every key of the bitmap, and for others that share a bit with one."""
    with_at = df.withColumn("_at", F.pmod(F.xxhash64(*key), F.lit(MARKS))).withColumn("_word", F.shiftright("_at", 6))
    joined = with_at.join(F.broadcast(bitmap), F.col("_word") == F.col("word"), "left")
    return joined.withColumn(name, F.coalesce(F.expr(f"bits & {BIT.format('_at')}") != 0, F.lit(False))).drop("_at", "_word", "word", "bits")


def write_pages(pages: DataFrame, path: str, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per page. Of equal payloads of at least ``min_revisit`` bytes the smallest id is the
    response; rows repeated under that id are responses too; a null id is never the smallest unless all are null.

    Groups are found on digests alone, combined before the shuffle. Bitmaps of fixed size tell each scan task which payloads surely occur
    once (they are written where they are read) and which surely are revisits (their payload is left behind). What is shuffled with its
    payload is about one row for each payload that occurs twice or more.
    """
    spark = pages.sparkSession
    register(spark)
    body = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), body.cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("http_length", F.octet_length("payload").cast("long"))
    long = rows.filter(F.col("http_length") >= min_revisit)
    groups = long.groupBy("payload_digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    twice = staged(groups.filter("n > 1").select(F.col("payload_digest").alias("_d"), "first_id"), "warc-twice")
    digest, own = (F.col("payload_digest"),), (F.col("payload_digest"), F.col("id").cast("string"))
    flagged = marked(rows, marks(twice, F.col("_d")), "maybe", *digest).withColumn("maybe", F.col("maybe") & (F.col("http_length") >= min_revisit))

    narrow = flagged.filter("maybe").drop("payload", "maybe").join(twice, F.col("payload_digest") == F.col("_d"), "left")
    narrow = narrow.withColumn("again", F.col("_d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")))
    decided = staged(narrow.drop("_d"), "warc-decided")
    firsts = decided.filter("NOT again").select(F.col("id").alias("_id"), F.col("payload_digest").alias("_d")).distinct()
    with_body = marked(flagged.filter("maybe"), marks(firsts, F.col("_d"), F.col("_id").cast("string")), "wanted", *own).filter("wanted")
    with_body = with_body.join(firsts, (F.col("payload_digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def response(df: DataFrame) -> DataFrame:
        return df.select(F.lit("response").alias("record_type"), urn(F.col("id")).alias("record_id"), "target_uri", "payload_digest", "payload", "http_length", F.lit(None).cast("string").alias("refers_to"))

    revisits = decided.filter("again").select(
        F.lit("revisit").alias("record_type"), urn(F.col("id")).alias("record_id"), "target_uri", "payload_digest", F.lit(b"").alias("payload"), "http_length", urn(F.col("first_id")).alias("refers_to")
    )
    records = response(flagged.filter("NOT maybe")).unionByName(response(with_body)).unionByName(revisits)
    records.write.format(NAME).mode("append").save(path)
    discard(twice, decided)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back by record type, both pushed down to the reader: of a response
    length and digest are taken from the payload that was read; a revisit's come from its headers, and responses' payloads are passed over."""
    path = shared_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_pages(pages, path)
    kind = pages.schema["page_id"].dataType
    page = page_of(F.col("record_id")).cast(kind).alias("page_id")
    full = read_warc(spark, path).filter("record_type = 'response'").select(
        page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to")
    )
    again = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(
        page, F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page_of(F.col("refers_to")).cast(kind).alias("refers_to")
    )
    return full.unionByName(again)


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""
