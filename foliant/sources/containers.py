"""Media containers (ISO base media: mp4, mov): what their sample tables say, read by seeking.

``video_info`` gives a row for each video track: frame count, time scale, duration, frames a second, size, key frames. Boxes are passed
over by their lengths; of a file of any size only headers and the tables that the asked columns need are read. ``video_frames`` gives
a row for each encoded frame: when it is shown, how long, where its bytes lie, whether it stands alone; with ``payload`` the bytes too. Decoding is
for a codec that the caller plugs in.

Files are listed on the driver, folder by folder, and dealt out in shares of ``filesAPartition`` files, or more where that made over ``partitions``
of them; a share's names are packed. A file that is no container, or is cut off before its tables, gives a row with an ``error`` in
``video_info`` and no frames; the other files are read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.shipping import ship

NAME = "media_containers"
INFO = "path string, bytes long, track int, frames long, time_scale long, duration double, fps double, width int, height int, key_frames long, error string"
FRAMES = "path string, track int, frame long, ts double, shown double, offset long, size long, key boolean, payload binary"
#: File endings, boxes that hold boxes, boxes read whole.
ENDINGS = (".mp4", ".mov", ".m4v")
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
FRAME_BATCH, INFO_BATCH = 4096, 1024
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


class NotAContainer(ValueError):
    pass


def boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the content) of the boxes between two places."""
    while at < end:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise NotAContainer("cut off within a box")
        size, kind = struct.unpack(">I4s", head)
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", f.read(8))[0], at + 16
        size = size or end - at  # 0: to the end
        if size < start - at or at + size > end:
            raise NotAContainer("a box reaches beyond its end")
        yield kind, start, at + size
        at += size


@dataclass
class Track:
    """Where a track's tables lie, and its heads."""

    handler: bytes = b""
    time_scale: int = 0
    ticks: int = 0
    width: int = 0
    height: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)


def tracks(f, length: int) -> list[Track]:
    """The tracks of an open file; tables are found, not read."""
    out: list[Track] = []
    seen = False

    def walk(start: int, end: int) -> None:
        nonlocal seen
        for kind, a, b in boxes(f, start, end):
            seen |= kind == b"moov"
            if kind == b"trak":
                out.append(Track())
            if kind in NESTED:
                walk(a, b)
            elif out and kind in (b"tkhd", b"mdhd", b"hdlr"):
                f.seek(a)
                head(out[-1], kind, f.read(min(b - a, 128)))
            elif out and kind in (b"stts", b"stss", b"stsz", b"stsc", b"stco", b"co64"):
                out[-1].tables[kind] = (a, b)

    def head(t: Track, kind: bytes, data: bytes) -> None:
        long = data[0] == 1
        if kind == b"tkhd":
            t.width, t.height = (x >> 16 for x in struct.unpack_from(">II", data, 88 if long else 76))
        elif kind == b"mdhd":
            t.time_scale, t.ticks = struct.unpack_from(">IQ", data, 20) if long else struct.unpack_from(">II", data, 12)
        else:
            t.handler = data[8:12]

    try:
        walk(0, length)
    except (struct.error, IndexError) as e:
        raise NotAContainer("a head is cut off") from e
    if not seen:
        raise NotAContainer("no movie box")
    return out


def numbers(f, t: Track, kind: bytes, skip: int, of: str) -> np.ndarray:
    """A table's entries, after ``skip`` bytes of head."""
    if kind not in t.tables:
        return np.empty(0, np.int64)
    a, b = t.tables[kind]
    f.seek(a + skip)
    return np.frombuffer(f.read(b - a - skip), of).astype(np.int64)


def frame_count(f, t: Track) -> int:
    if b"stsz" not in t.tables:
        return 0
    f.seek(t.tables[b"stsz"][0] + 8)
    return struct.unpack(">I", f.read(4))[0]


def key_count(f, t: Track, frames: int) -> int:
    """Without a table every frame stands alone."""
    if b"stss" not in t.tables:
        return frames
    f.seek(t.tables[b"stss"][0] + 4)
    return struct.unpack(">I", f.read(4))[0]


def sample_table(f, t: Track) -> tuple[np.ndarray, ...]:
    """Of every frame: start and length in ticks, offset and size in bytes, whether it stands alone."""
    n = frame_count(f, t)
    f.seek(t.tables[b"stsz"][0] + 4)
    one = struct.unpack(">I", f.read(4))[0]
    size = np.full(n, one, np.int64) if one else numbers(f, t, b"stsz", 12, ">u4")[:n]
    times = numbers(f, t, b"stts", 8, ">u4").reshape(-1, 2)
    shown = np.repeat(times[:, 1], times[:, 0])[:n]
    key = np.ones(n, bool)
    if b"stss" in t.tables:
        key[:] = False
        key[numbers(f, t, b"stss", 8, ">u4") - 1] = True
    chunks = numbers(f, t, b"co64", 8, ">u8") if b"co64" in t.tables else numbers(f, t, b"stco", 8, ">u4")
    deal = numbers(f, t, b"stsc", 8, ">u4").reshape(-1, 3)
    each = np.repeat(deal[:, 1], np.diff(np.append(deal[:, 0] - 1, len(chunks))))  # frames of every chunk
    first = np.cumsum(each) - each
    before = np.cumsum(size) - size
    chunk = np.repeat(np.arange(len(chunks)), each)[:n]
    if not len(shown) == len(size) == len(chunk) == n:
        raise NotAContainer("tables that don't agree")
    offset = chunks[chunk] + before - before[np.minimum(first, max(0, n - 1))][chunk] if n else size
    return np.cumsum(shown) - shown, shown, offset, size, key


@dataclass
class Share(InputPartition):
    """Packed lists of path and length."""

    packed: tuple[bytes, ...]

    def files(self) -> Iterator[tuple[str, int]]:
        for p in self.packed:
            yield from map(tuple, json.loads(zlib.decompress(p)))


class ContainerReader(DataSourceReader):
    """``schema``: the asked columns; tables that none of them needs are not read."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.share = options["path"].rstrip("/"), int(options.get("filesapartition", 64))
        self.most = int(options.get("partitions", 1024))
        self.frames, self.keys_only = options.get("frames", "false") == "true", options.get("keysonly", "false") == "true"
        self.columns = schema.names

    def partitions(self) -> list[Share]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        base = self.path.removesuffix(root)
        info = fs.get_file_info(root)
        found = [(self.path, info.size)] if info.type == pafs.FileType.File else self.listed(fs, root, base)
        packed = [zlib.compress(json.dumps(x).encode()) for x in batched((x for x in found if x[0].lower().endswith(ENDINGS)), self.share)]
        return [Share(x) for x in batched(packed, -(-len(packed) // self.most))] if packed else [Share(())]

    def listed(self, fs: pafs.FileSystem, folder: str, base: str) -> Iterator[tuple[str, int]]:
        """Paths and lengths of the files below a folder."""
        inner = []
        for x in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
            if x.base_name[0] in "._":
                continue
            if x.type == pafs.FileType.Directory:
                inner.append(x.path)
            elif x.type == pafs.FileType.File:
                yield base + x.path, x.size
        for path in inner:
            yield from self.listed(fs, path, base)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if self.frames:
            for path, length in partition.files():
                with self.opened(path) as f:
                    yield from self.frame_rows(f, path, length)
            return
        for held in batched(self.infos(partition), INFO_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], self.kind(c)) for c in self.columns], self.columns)

    def infos(self, partition: Share) -> Iterator[dict]:
        for path, length in partition.files():
            with self.opened(path) as f:
                yield from self.info_rows(f, path, length)

    @staticmethod
    def opened(path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(name)

    def kind(self, column: str) -> pa.DataType:
        return ARROW[dict(x.split() for x in (FRAMES if self.frames else INFO).split(", "))[column]]

    def info_rows(self, f, path: str, length: int) -> list[dict]:
        want = set(self.columns)
        try:
            out = []
            for k, t in enumerate(tracks(f, length)):
                if t.handler != b"vide":
                    continue
                n = frame_count(f, t) if want & {"frames", "fps", "key_frames"} else 0
                seconds = t.ticks / t.time_scale if t.time_scale else 0.0
                row = {"path": path, "bytes": length, "track": k, "frames": n, "time_scale": t.time_scale, "duration": seconds, "fps": n * t.time_scale / t.ticks if t.ticks else 0.0, "width": t.width, "height": t.height}
                out.append(row | ({"key_frames": key_count(f, t, n)} if "key_frames" in want else {}))
            return out
        except (NotAContainer, struct.error) as e:
            return [{"path": path, "bytes": length, "error": str(e)}]

    def frame_rows(self, f, path: str, length: int, first: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of the frames from ``first`` up to ``end`` of every video track."""
        try:
            found = [(k, t, sample_table(f, t)) for k, t in enumerate(tracks(f, length)) if t.handler == b"vide" and b"stsz" in t.tables]
        except (NotAContainer, struct.error, ValueError, IndexError):
            return
        for k, t, (start, shown, offset, size, key) in found:
            own = np.flatnonzero(key) if self.keys_only else np.arange(len(size))
            own = own[(own >= first) & (own < (len(size) if end is None else end))]
            step = 16 if "payload" in self.columns else FRAME_BATCH
            for i in range(0, len(own), step):
                at = own[i : i + step]
                scale = t.time_scale or 1
                cols = {"path": [path] * len(at), "track": [k] * len(at), "frame": at, "ts": start[at] / scale, "shown": shown[at] / scale, "offset": offset[at], "size": size[at], "key": key[at]}
                if "payload" in self.columns:
                    cols["payload"] = [self.piece(f, int(a), int(n)) for a, n in zip(offset[at], size[at])]
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], self.kind(c)) for c in self.columns], self.columns)

    @staticmethod
    def piece(f, at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)


class MediaContainers(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FRAMES if self.options.get("frames", "false") == "true" else INFO

    def reader(self, schema: T.StructType) -> ContainerReader:
        return ContainerReader(dict(self.options), schema)


def _load(spark: SparkSession, path: str, whole: str, columns: list[str] | None, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaContainers)
    asked = [x for x in whole.split(", ") if not columns or x.split()[0] in columns]
    return spark.read.format(NAME).options(**options).schema(", ".join(asked)).load(path)


def video_info(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each video track below ``path``; ``columns``: those to be read."""
    return _load(spark, path, INFO, columns)


def video_frames(spark: SparkSession, path: str, payload: bool = False, keys_only: bool = False) -> DataFrame:
    """A row for each frame; ``keys_only``: of those that stand alone."""
    names = [c.split()[0] for c in FRAMES.split(", ")]
    return _load(spark, path, FRAMES, names if payload else names[:-1], frames="true", keysOnly=str(keys_only).lower())


# -- writing ------------------------------------------------------------------------------------


def box(kind: bytes, *content: bytes, long: bool = False) -> bytes:
    size = sum(map(len, content))
    return (struct.pack(">I4sQ", 1, kind, size + 16) if long else struct.pack(">I4s", size + 8, kind)) + b"".join(content)


def _table(kind: bytes, entries: list[tuple], of: str, head: bytes = b"") -> bytes:
    return box(kind, bytes(4), head, struct.pack(">I", len(entries)), *(struct.pack(of, *e) for e in entries))


def container(frames: list[bytes], shown: list[int], time_scale: int = 1000, keys: list[int] | None = None, width: int = 640, height: int = 480, handler: bytes = b"vide", front: bool = False, chunk: int = 8, long: bool = False) -> bytes:
    """A file of one track. ``shown``: ticks of each frame; ``keys``: frames (from 0) that stand alone, None for all; ``front``: the movie box comes
    before the frames; ``long``: lengths and offsets of 64 bits."""
    kind = box(b"ftyp", b"isom", bytes(4), b"isom")
    runs: list[list[int]] = []
    for d in shown:
        if runs and runs[-1][1] == d:
            runs[-1][0] += 1
        else:
            runs.append([1, d])
    first = list(range(0, len(frames), chunk))
    deal = [(1, chunk, 1)] if frames else []
    if len(frames) % chunk and len(first) > 1:
        deal.append((len(first), len(frames) % chunk, 1))
    elif len(frames) % chunk:
        deal = [(1, len(frames), 1)]

    def movie(base: int) -> bytes:
        places, at = [], base
        for i, data in enumerate(frames):
            if i % chunk == 0:
                places.append((at,))
            at += len(data)
        tables = [_table(b"stts", runs, ">II"), _table(b"stsc", deal, ">III"), _table(b"stsz", [(len(d),) for d in frames], ">I", bytes(4)), _table(b"co64" if long else b"stco", places, ">Q" if long else ">I")]
        if keys is not None:
            tables.append(_table(b"stss", [(k + 1,) for k in keys], ">I"))
        ticks = sum(shown)
        mdhd = box(b"mdhd", struct.pack(">B3xQQIQI", 1, 0, 0, time_scale, ticks, 0) if long else struct.pack(">IIIIII", 0, 0, 0, time_scale, ticks, 0))
        tkhd = box(b"tkhd", (struct.pack(">B3xQQIIQ", 1, 0, 0, 1, 0, ticks) if long else struct.pack(">IIIIII", 0, 0, 0, 1, 0, ticks)) + bytes(52) + struct.pack(">II", width << 16, height << 16))
        hdlr = box(b"hdlr", bytes(8), handler, bytes(13))
        return box(b"moov", box(b"mvhd", bytes(100)), box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", *tables)))))

    data = box(b"mdat", *frames, long=long)
    lead = 16 if long else 8
    if front:
        return kind + movie(len(kind) + len(movie(0)) + lead) + data
    return kind + data + movie(len(kind) + lead)
