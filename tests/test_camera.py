"""A camera's frames come once each, in batches of even size, through failures and restarts."""

from __future__ import annotations

import os
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.plans import capture
from foliant.sources import camera, containers

MANY = (30, 0, 25, 7)


def segment(folder, k, n):
    frames = [b"%d-%d" % (k, i) for i in range(n)]
    (folder / f"seg-{k:03d}.mp4").write_bytes(containers.container(frames, [40] * n))
    return [f.decode() for f in frames]


def run(spark, tmp_path, fail_at=None, most=20):
    sizes = []

    def write(batch, number):
        if number == fail_at:
            batch.limit(1).collect()
            raise RuntimeError("power cut")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        sizes.append(batch.count())

    frames = camera.camera(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", most)
    query = frames.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sizes


def got(spark, tmp_path):
    return sorted(r["p"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("payload").cast("string").alias("p")).collect())


def test_each_frame_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = [f for k, n in enumerate(MANY) for f in segment(tmp_path / "in", k, n)]
    (tmp_path / "in" / "seg-900.mp4").write_bytes(b"not finished")
    (tmp_path / "in" / "notes.txt").write_bytes(b"x")
    with pytest.raises(Exception, match="power cut"):
        run(spark, tmp_path, fail_at=1)
    sizes = run(spark, tmp_path)  # the failed batch again, then the rest
    assert got(spark, tmp_path) == sorted(want) and max(sizes) <= 20
    want += segment(tmp_path / "in", 5, 45)
    sizes = run(spark, tmp_path)
    assert got(spark, tmp_path) == sorted(want) and sum(sizes) == 45 and max(sizes) <= 20
    assert sum(run(spark, tmp_path)) == 0  # nothing new
    want += segment(tmp_path / "in", 900, 3)  # now finished
    run(spark, tmp_path)
    assert got(spark, tmp_path) == sorted(want)
    segment(tmp_path / "in", 4, 2)
    with pytest.raises(Exception, match="came late"):
        run(spark, tmp_path)


def test_offsets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = [c.split()[0] for c in containers.FRAMES.split(", ")]
    schema = spark.createDataFrame([], containers.FRAMES).schema
    reader = lambda: camera.CameraReader({"path": f"file://{tmp_path}/in", "progress": f"file://{tmp_path}/p", "framesperbatch": "10"}, schema)
    assert reader().latestOffset() == reader().initialOffset()
    for k, n in enumerate((4, 9)):
        segment(tmp_path / "in", k, n)
    first = reader().latestOffset()
    assert (first["file"], first["frame"]) == ("seg-001.mp4", 6)
    second = reader().latestOffset()  # another reader, after a restart
    assert (second["file"], second["frame"]) == ("seg-001.mp4", 9)
    r = reader()
    rows = [x for a, b in ((r.initialOffset(), first), (first, second)) for p in r.partitions(a, b) for batch in r.read(p) for x in batch.column(names.index("payload")).to_pylist()]
    assert rows == [b"%d-%d" % (k, i) for k, n in enumerate((4, 9)) for i in range(n)]
    assert r.partitions(second, second) == []


def test_folders_are_listed_when_their_turn_comes(spark, tmp_path, monkeypatch):
    """Segments in folders: a batch lists the folders it takes from, those passed only when they changed, and keeps no segment that was passed."""
    days, long_ago = [tmp_path / "in" / f"day-{k:02d}" for k in range(30)], time.time() - 3600
    (tmp_path / "in").mkdir()
    want = []
    for day in days:
        day.mkdir()
        want += [f"{day.name}:{f}" for k in range(4) for f in segment(day, k, 3)]
        os.utime(day, (long_ago, long_ago))
    schema = spark.createDataFrame([], containers.FRAMES).schema
    r = camera.CameraReader({"path": f"file://{tmp_path}/in", "progress": f"file://{tmp_path}/p", "framesperbatch": "12", "nested": "true"}, schema)
    seen, listed = [], r.listed
    monkeypatch.setattr(r, "listed", lambda folder="": seen.append(folder) or listed(folder))
    at, got = r.initialOffset(), []
    for k in range(30):
        seen.clear()
        end = r.latestOffset()
        assert end == {"file": f"day-{k:02d}/seg-003.mp4", "frame": 3, "before": 4 * k + 3}
        assert len(seen) <= 8 and len(r.counts) <= 8
        for p in r.partitions(at, end):
            for batch in r.read(p):
                got += [f"{x['path'].split('/')[-2]}:{x['payload'].decode()}" for x in batch.select(["path", "payload"]).to_pylist()]
        at = end
    assert got == want
    assert r.latestOffset() == at
    segment(days[3], 9, 1)
    with pytest.raises(ValueError, match="came late"):
        r.latestOffset()
    flat = camera.CameraReader({"path": f"file://{tmp_path}/in", "progress": f"file://{tmp_path}/q"}, schema)
    assert flat.latestOffset() == flat.initialOffset()  # folders only where they are asked for


def test_nested_stream(spark, tmp_path):
    """Names are in order folder by folder, as paths are not: "a-b/" sorts before "a/"."""
    want = []
    for name in ("a-b", "a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        want += segment(tmp_path / "in" / name, len(want), 7)
    frames = camera.camera(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress", 5, nested=True)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    query = frames.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert got(spark, tmp_path) == sorted(want)


def test_recordings_lie_in_bounded_folders(spark, tmp_path):
    """Users by 256, recordings of a user by 16: no folder gets more files, and ids of every size come back."""
    ids = [(e * capture.RECORDING + u, u) for u in range(600) for e in ((0, 40) if u % 100 == 0 else (0,))] + [(7, 10**12), (8, 2**62)]
    events = spark.createDataFrame([(e, u, datetime(2024, 1, 1), "view") for e, u in ids], "event_id long, user_id long, ts timestamp, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    capture.recordings(spark, str(tmp_path), str(tmp_path / "in"))
    files = [p.relative_to(tmp_path / "in") for p in (tmp_path / "in").rglob("*.mp4")]
    assert len(files) == len(ids) and max(Counter(p.parent for p in files).values()) <= 256
    rows = capture.camera_frames(spark, str(tmp_path)).collect()
    assert sorted((r["last_id"], r["session"]) for r in rows) == sorted(ids)
