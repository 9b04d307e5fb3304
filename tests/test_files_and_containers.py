"""The sink of files and the source of media containers: what is written is parsed back, what failed is never seen."""

from __future__ import annotations

import io
import pickle
import re
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.sources import containers, files


def seen(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not any(x[0] in "_." for x in p.relative_to(path).parts)}


def rows(spark, names, n=5, text="x"):
    return spark.createDataFrame([(f, k, bytearray(f"{text}{f}{k};".encode()), f"p{k:02d}.txt") for f in names for k in range(n)], "file string, part long, content binary, name string").repartition(3)


def test_raw_append_and_overwrite(spark, tmp_path):
    files.write_files(rows(spark, ["a.bin", "d/b.bin"]), str(tmp_path))
    assert (tmp_path / "d/b.bin").read_bytes() == b"".join(b"xd/b.bin%d;" % k for k in range(5))
    files.write_files(rows(spark, ["c.bin"]), str(tmp_path))
    assert seen(tmp_path) == {"a.bin", "d/b.bin", "c.bin"} == {r["file"] for r in files.written(spark, str(tmp_path)).collect()}
    files.write_files(rows(spark, ["c.bin", "e.bin"], text="y"), str(tmp_path), mode="overwrite")
    assert seen(tmp_path) == {"c.bin", "e.bin"} and (tmp_path / "c.bin").read_bytes().startswith(b"yc")
    assert not list(tmp_path.glob("_attempts/*"))


def test_failed_job_leaves_nothing(spark, tmp_path):
    files.write_files(rows(spark, ["a.bin"]), str(tmp_path))
    good, before = rows(spark, [f"f{k}.bin" for k in range(20)]), seen(tmp_path)
    bad = spark.createDataFrame([("../out.bin", 0, bytearray(b"z"), "n")], good.schema)
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(good.unionByName(bad), str(tmp_path))
    assert seen(tmp_path) == before and not list(tmp_path.glob("_attempts/*")) and not (tmp_path.parent / "out.bin").exists()
    for name in (None, "", "/a", "_a", "a/../b", "a//b", "a/"):
        with pytest.raises(ValueError):
            files.safe(name)


def test_repeated_attempt_shows_once(spark, tmp_path):
    """An attempt whose files are not in any commit message is not seen, and goes with the commit."""
    writer = files.FileWriter({"path": str(tmp_path), "kind": "raw"}, False)
    batch = [b for b in rows(spark, ["a.bin"]).select("file", "part", "content").sort("part").toArrow().to_batches()]
    lost, done = writer.write(iter(batch)), writer.write(iter(batch))
    assert lost.folder != done.folder and seen(tmp_path) == set()
    writer.commit([done, None])
    assert seen(tmp_path) == {"a.bin"} and not Path(lost.folder).exists()
    two = files.FileWriter({"path": str(tmp_path), "kind": "raw"}, False)
    with pytest.raises(ValueError, match="same name"):
        two.commit([two.write(iter(batch)), two.write(iter(batch))])


def test_messages_do_not_grow_with_files(spark, tmp_path):
    """What the driver gets of a task is as small for 400 files as for one; every file comes through, and names still have to differ."""
    batches = lambda names: iter(rows(spark, names, 1).select("file", "part", "content").sort("file").toArrow().to_batches())
    names = [f"d{k % 4}/file-{k:05d}.bin" for k in range(400)]
    writer = files.FileWriter({"path": str(tmp_path), "kind": "raw"}, False)
    done = [writer.write(batches(names[:350])), writer.write(batches(names[350:])), writer.write(iter([]))]
    assert max(len(pickle.dumps(m)) for m in done) < 500
    writer.commit(done)
    assert seen(tmp_path) == set(names) and not list(tmp_path.glob("_attempts/*"))
    assert [r["file"] for r in files.written(spark, str(tmp_path)).sort("file").collect()] == sorted(names)
    two = files.FileWriter({"path": str(tmp_path), "kind": "raw"}, False)
    with pytest.raises(ValueError, match="same name"):
        two.commit([two.write(batches(["x.bin", *names[:50]])), two.write(batches(["y.bin", names[7]]))])
    assert seen(tmp_path) == set(names)


def test_zip(spark, tmp_path):
    files.write_files(rows(spark, ["a.zip", "b.zip"], 12), str(tmp_path), "zip")
    z = zipfile.ZipFile(tmp_path / "a.zip")
    assert z.testzip() is None and z.namelist() == [f"p{k:02d}.txt" for k in range(12)] and z.read("p07.txt") == b"xa.zip7;"


def test_pdf(spark, tmp_path):
    pages = [("s", k + 1, bytearray(b"\xff\xd8jpeg%d\xff\xd9" % k * 50), 800, 600) for k in range(7)]
    df = spark.createDataFrame(pages, "session string, position int, jpeg binary, width int, height int")
    files.write_files(files.pdf_rows(df), str(tmp_path), "pdf")
    (name,) = seen(tmp_path)
    data = (tmp_path / name).read_bytes()
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    many = int(re.match(rb"xref\n0 (\d+)\n", data[start:])[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert many == len(places) + 1 == 3 + 3 * 7
    for n, at in enumerate(places, 1):
        assert data[at:].startswith(b"%d 0 obj\n" % n)
    kids = re.search(rb"/Count 7 /Kids \[([^\]]*)\]", data)[1].split(b"R")[:-1]
    for k, kid in enumerate(kids):
        image = int(re.search(rb"/I (\d+) 0 R", data[places[int(kid.split()[0]) - 1] :])[1])
        body = data[places[image - 1] :]
        length = int(re.search(rb"/Length (\d+) >>\nstream\n", body)[1])
        at = body.index(b"stream\n") + 7
        assert body[at : at + length] == bytes(pages[k][2])


# -- containers ---------------------------------------------------------------------------------


def video(n, **how):
    frames = [bytes([k % 256]) * (5 + k * 7 % 40) for k in range(n)]
    shown = [40 if k % 3 else 33 for k in range(n)]
    return frames, shown, containers.container(frames, shown, **how)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("media")
    made = {"a.mp4": (100, {"keys": [0, 50, 99]}), "sub/b.MOV": (17, {"front": True, "time_scale": 600}), "c.mp4": (40, {"long": True, "keys": [0], "width": 1920, "height": 1080}), "d.mp4": (3, {}), "e.mp4": (8, {"chunk": 4}), "none.mp4": (0, {})}
    (at / "sub").mkdir()
    out = {}
    for name, (n, how) in made.items():
        out[name] = *video(n, **how), how
        (at / name).write_bytes(out[name][2])
    (at / "sound.mp4").write_bytes(video(5, handler=b"soun")[2])
    (at / "cut.mp4").write_bytes(out["a.mp4"][2][:-40])
    (at / "text.mp4").write_bytes(b"not a container at all, only text of some length")
    (at / "other.txt").write_bytes(b"x")
    (at / "_hidden.mp4").write_bytes(out["a.mp4"][2])
    return at, out


def test_info(spark, folder):
    at, made = folder
    got = {r["path"].removeprefix(f"{at}/"): r for r in containers.video_info(spark, str(at)).collect()}
    assert set(got) == set(made) | {"cut.mp4", "text.mp4"}
    for name, (frames, shown, data, how) in made.items():
        r, scale = got[name], how.get("time_scale", 1000)
        assert (r["frames"], r["time_scale"], r["bytes"], r["error"]) == (len(frames), scale, len(data), None)
        assert r["duration"] == pytest.approx(sum(shown) / scale) and r["fps"] == pytest.approx(len(frames) * scale / sum(shown) if frames else 0)
        assert (r["width"], r["height"]) == (how.get("width", 640), how.get("height", 480))
        assert r["key_frames"] == len(how.get("keys", frames))
    assert got["cut.mp4"]["error"] and got["text.mp4"]["error"]
    few = containers.video_info(spark, str(at), ["path", "fps"])
    assert few.columns == ["path", "fps"] and few.count() == len(got)
    one = containers.video_info(spark, str(at / "a.mp4")).collect()
    assert len(one) == 1 and one[0]["frames"] == 100


def test_frames(spark, folder):
    at, made = folder
    got = containers.video_frames(spark, str(at), payload=True).collect()
    for name, (frames, shown, data, how) in made.items():
        own = sorted((r for r in got if r["path"] == f"{at}/{name}"), key=lambda r: r["frame"])
        assert [bytes(r["payload"]) for r in own] == frames
        assert all(data[r["offset"] : r["offset"] + r["size"]] == frames[r["frame"]] for r in own)
        scale = how.get("time_scale", 1000)
        assert [r["ts"] for r in own] == pytest.approx([sum(shown[:k]) / scale for k in range(len(frames))])
        assert [r["frame"] for r in own if r["key"]] == how.get("keys", list(range(len(frames))))
    keys = containers.video_frames(spark, str(at), keys_only=True)
    assert "payload" not in keys.columns and keys.filter(F.col("path").endswith("/a.mp4")).count() == 3


def test_partitions_stay_few_and_small(spark, tmp_path):
    """3,000 files in folders: each is read once, in no more partitions than asked for, whose paths don't lie on the driver as they are."""
    data, paths = video(3)[2], []
    for k in range(3000):
        paths.append(f"{tmp_path}/{k // 1000:020d}/{k // 100:020d}/{k:020d}.mp4")
        if k % 100 == 0:
            Path(paths[-1]).parent.mkdir(parents=True)
        Path(paths[-1]).write_bytes(data)
    schema = spark.createDataFrame([], containers.INFO).select("path", "bytes", "frames").schema
    shares = containers.ContainerReader({"path": str(tmp_path), "partitions": "10"}, schema).partitions()
    assert len(shares) <= 10 and sum(len(pickle.dumps(x)) for x in shares) < sum(map(len, paths)) / 5
    assert [x for s in shares for x in s.files()] == [(p, len(data)) for p in paths]
    few = containers.ContainerReader({"path": str(tmp_path), "partitions": "1"}, schema)
    rows = [r for s in few.partitions() for b in few.read(s) for r in b.to_pylist()]
    assert rows == [{"path": p, "bytes": len(data), "frames": 3} for p in paths]
    assert containers.video_info(spark, str(tmp_path)).count() == 3000
    assert containers.ContainerReader({"path": str(tmp_path)}, schema).partitions()[0].packed[1:] == ()


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_frames_are_passed_over():
    data = containers.container([bytes(1 << 20)] * 5, [40] * 5)
    f = Counted(data)
    (t,) = containers.tracks(f, len(data))
    assert containers.frame_count(f, t) == 5 and f.taken < 1000


def test_broken_boxes():
    for data in (b"", b"\0\0", struct.pack(">I4s", 4, b"moov"), struct.pack(">I4s", 99, b"moov"), containers.box(b"moov", containers.box(b"trak", containers.box(b"mdhd", b"\0")))):
        with pytest.raises(containers.NotAContainer):
            containers.tracks(io.BytesIO(data), len(data))
