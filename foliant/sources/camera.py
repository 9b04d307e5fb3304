"""A camera as a streaming source: recordings that keep coming into a folder, read frame by frame.

A camera writes segments (media containers) whose names rise, such as times. An offset is a place in that order: a segment's name and how many
of its frames are taken. A batch ends ``framesPerBatch`` frames after the last end that was given out, at the latest, so a camera that was
alone for a night is caught up with in even batches. Between two offsets the frames are always the same, so a batch that failed is
read again as it was, and after a restart from the checkpoint each frame comes once.

Spark does not tell a Python source where it stands when it asks how far it may read, so the last end given out is kept in the folder that the option
``progress`` names (one for each stream). It only bounds the size of batches; what was read is in Spark's own checkpoint.

A segment that isn't finished (its tables are not there yet) ends the batch before it; so does one that never gets finished, until it
goes. A segment whose name comes late, before what is taken, raises, since its frames would be lost. Of a segment's tracks the first video
track counts.

A folder is listed as a whole, and its list is held while it is gone through. Cameras of very many segments lay them out in folders whose names rise as
well, such as days (``nested``): a batch lists the folders that it takes from, and of those passed only the ones changed since. What the driver
holds then grows with a folder's segments and the number of folders.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from foliant.shipping import ship
from foliant.sources.containers import ENDINGS, FRAMES, ContainerReader, NotAContainer, frame_count, tracks

NAME = "camera_frames"
SLICE = 2048
#: Seconds after which a folder's time of change is taken to tell every change: less than what clocks and file systems count in is not seen.
SETTLED = 10


@dataclass
class Pieces(InputPartition):
    """Name, length, first frame and end of parts of segments, about ``SLICE`` frames together."""

    parts: tuple[tuple[str, int, int, int], ...]


def order(name: str) -> tuple[str, ...]:
    """Segments' names in order: folder by folder."""
    return tuple(name.split("/"))


class CameraReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("framesperbatch", 10_000))
        self.progress = options["progress"].rstrip("/")
        self.frames = ContainerReader({"path": self.path, "frames": "true"}, schema)
        self.nested = options.get("nested", "false") == "true"
        self.counts: dict[str, int] = {}
        self.passed: dict[str, tuple[int, int]] = {}  # time of change and segments, by folder

    # -- where the stream stands --

    def initialOffset(self) -> dict:
        return {"file": "", "frame": 0, "before": 0}

    def latestOffset(self) -> dict:
        """``before``: how many segments lie before the one named."""
        at = self.given() or self.initialOffset()
        place = order(at["file"])
        before = self.before(place)
        if before > at["before"]:
            raise ValueError(f"a segment came late, before {at['file']}: {before} lie there, {at['before']} were passed")
        self.counts = {n: c for n, c in self.counts.items() if order(n) >= place}
        left, now = self.most, dict(at)
        for k, (name, _) in enumerate(self.segments(place)):
            if left <= 0 or (count := self.count(name)) is None:
                break
            first = at["frame"] if name == at["file"] else 0
            take = min(left, count - first)
            now, left = {"file": name, "frame": first + take, "before": before + k}, left - take
        if now != at:
            self.give(now)
        return now

    def given(self) -> dict | None:
        fs, root = pafs.FileSystem.from_uri(self.progress)
        info = fs.get_file_info(f"{root}/end.json")
        if info.type != pafs.FileType.File:
            return None
        with fs.open_input_stream(info.path) as f:
            return json.load(f)

    def give(self, end: dict) -> None:
        fs, root = pafs.FileSystem.from_uri(self.progress)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_end.tmp") as f:
            f.write(json.dumps(end).encode())
        fs.move(f"{root}/_end.tmp", f"{root}/end.json")

    # -- segments --

    def listed(self, folder: str = "") -> list[pafs.FileInfo]:
        """Segments, and folders where they count, of one folder, in order."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        own = lambda x: self.nested if x.type == pafs.FileType.Directory else x.type == pafs.FileType.File and x.base_name.lower().endswith(ENDINGS)
        return sorted((x for x in found if x.base_name[0] not in "._" and own(x)), key=lambda x: x.base_name)

    def segments(self, place: tuple[str, ...] = (), folder: str = "") -> Iterator[tuple[str, int]]:
        """Names below the path, and lengths, from a place on; a folder is listed when its turn comes."""
        for x in self.listed(folder):
            if place and x.base_name < place[0]:
                continue
            if x.type == pafs.FileType.Directory:
                yield from self.segments(place[1:] if place and x.base_name == place[0] else (), f"{folder}{x.base_name}/")
            else:
                yield folder + x.base_name, x.size

    def before(self, place: tuple[str, ...], folder: str = "") -> int:
        """How many segments lie before a place."""
        count = 0
        for x in self.listed(folder):
            if not place or x.base_name > place[0]:
                break
            if x.type == pafs.FileType.Directory:
                count += self.before(place[1:], f"{folder}{x.base_name}/") if x.base_name == place[0] else self.within(x, f"{folder}{x.base_name}/")
            elif x.base_name < place[0]:
                count += 1
        return count

    def within(self, info: pafs.FileInfo, folder: str) -> int:
        """How many segments a folder holds. One without folders isn't listed again until its time of change is another."""
        if (known := self.passed.get(folder)) and known[0] == info.mtime_ns:
            return known[1]
        now, found = time.time(), self.listed(folder)
        inner = [x for x in found if x.type == pafs.FileType.Directory]
        count = len(found) - len(inner) + sum(self.within(x, f"{folder}{x.base_name}/") for x in inner)
        if not inner and info.mtime_ns is not None and now - info.mtime_ns / 1e9 > SETTLED:
            self.passed[folder] = info.mtime_ns, count
        return count

    def opened(self, name: str):
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs.open_input_file(f"{root}/{name}")

    def count(self, name: str) -> int | None:
        """Frames of a finished segment; None for one that isn't."""
        if name not in self.counts:
            with self.opened(name) as f:
                try:
                    video = next((t for t in tracks(f, f.size()) if t.handler == b"vide"), None)
                    self.counts[name] = frame_count(f, video) if video else 0
                except (NotAContainer, struct.error):
                    return None
        return self.counts[name]

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        out: list[Pieces] = []
        held, total = [], 0
        for name, length in self.segments(order(start["file"])):
            if order(name) > order(end["file"]):
                break
            first = start["frame"] if name == start["file"] else 0
            last = end["frame"] if name == end["file"] else self.count(name)
            if last is None:
                raise ValueError(f"{name} was finished and is not any more")
            for i in range(first, last, SLICE):
                part = (name, length, i, min(last, i + SLICE))
                if held and total + part[3] - i > SLICE:
                    out.append(Pieces(tuple(held)))
                    held, total = [], 0
                held.append(part)
                total += part[3] - i
        return [*out, Pieces(tuple(held))] if held else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for name, length, first, end in partition.parts:
            with self.opened(name) as f:
                yield from self.frames.frame_rows(f, f"{self.path}/{name}", length, first, end)


class Camera(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema: T.StructType) -> CameraReader:
        return CameraReader(dict(self.options), schema)


def camera(spark: SparkSession, path: str, progress: str, frames_per_batch: int = 10_000, nested: bool = False) -> DataFrame:
    """The frames of a folder of segments, streaming, with their bytes. ``nested``: of the folders in it too."""
    ship(spark)
    spark.dataSource.register(Camera)
    return spark.readStream.format(NAME).option("progress", progress).option("framesPerBatch", str(frames_per_batch)).option("nested", str(nested).lower()).load(path)
