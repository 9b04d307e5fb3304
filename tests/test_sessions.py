"""Stateful capture sessions: equal to the batch folds however frames come in, after restarts too, with state that is appended to."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators import folds
from foliant.streaming import sessions, stateful

FRAMES = "session string, id long, ts timestamp, hash array<long>, session_start boolean, remove_id long"
START = datetime(2024, 1, 1)


def frames(n=80, seed=5, step=0.25):
    rng = random.Random(seed)
    rows = [(f"s{i % 3}", i, START + timedelta(seconds=i * step + rng.choice([0, 0.001, 0.1])), [rng.getrandbits(5) - 3, -rng.getrandbits(2)], None, None) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def put(spark, folder, rows):
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)  # files are taken in the order of their times


def batch(spark, rows, gap, threshold):
    df = spark.createDataFrame(rows, FRAMES)
    taken = folds.gap_sample(df, ["session"], "ts", gap, ["id"], ["id", "hash"])
    out = folds.greedy_dedup(taken, ["session"], [F.col("ts"), F.col("id")], "hash", threshold, ["id", "ts"])
    return sorted((r["session"], r["id"], r["ts"], r["ordinal"]) for r in out.collect())


def run(spark, tmp_path, **how):
    pages = sessions.session_pages(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **how)
    if how.get("ttl_ms"):  # does not end by itself
        seen = tmp_path / "ck" / "sources" / "0"
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
        query = pages.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
        files, end = len(list((tmp_path / "in").glob("*.parquet"))), time.time() + 60
        while time.time() < end and (len([f for f in seen.glob("*") if f.name.isdigit()]) if seen.exists() else 0) < files:
            time.sleep(0.1)
        after = query.lastProgress["batchId"] if query.lastProgress else -1
        while time.time() < end and (not query.lastProgress or query.lastProgress["batchId"] < max(after, 0) + 3):
            time.sleep(0.1)
        query.stop()
        assert query.exception() is None
    else:
        query = stateful.persist(pages, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert query.awaitTermination(90)
    return sorted((r["session"], r["id"], r["ts"], r["ordinal"]) for r in spark.read.parquet(str(tmp_path / "out")).select("session", "id", "ts", "ordinal").collect())


END = ("end", 10**6, START + timedelta(days=30), [0, 0], None, None)


def test_shuffled_batches_and_restart_equal_batch(spark, tmp_path):
    rows = frames()
    want = batch(spark, rows, 0.5, 1)
    late = rows[:]
    random.Random(1).shuffle(late)
    for k in range(3):
        put(spark, tmp_path / "in", late[k::3])
    before = run(spark, tmp_path, gap=0.5, threshold=1, delay="10 days")
    assert before == []  # nothing is final yet
    state = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", name).load()
    assert state("waiting").count() == len(rows)
    put(spark, tmp_path / "in", [END])
    got = run(spark, tmp_path, gap=0.5, threshold=1, delay="10 days")  # from the checkpoint
    assert [r for r in got if r[0] != "end"] == want and len(want) > 15
    assert state("kept").count() == len(got) and state("seen").count() == len(got) and state("waiting").count() == len(got) - len(want) + (len(got) == len(want))


def test_a_little_disorder_with_a_short_delay(spark, tmp_path):
    rows = frames(90)
    want = batch(spark, rows, 0.5, 1)
    for k in range(0, 90, 15):  # neighbouring parts change places
        part = rows[k : k + 15]
        random.Random(k).shuffle(part)
        put(spark, tmp_path / "in", part)
    put(spark, tmp_path / "in", [END])
    got = run(spark, tmp_path, gap=0.5, threshold=1, delay="5 seconds")
    assert [r for r in got if r[0] != "end"] == want


def test_as_they_come_with_restart(spark, tmp_path):
    rows = frames(60)
    put(spark, tmp_path / "in", rows[:20])
    put(spark, tmp_path / "in", rows[20:45])
    first = run(spark, tmp_path, gap=0.5, threshold=1)
    put(spark, tmp_path / "in", rows[45:])
    got = run(spark, tmp_path, gap=0.5, threshold=1)
    assert got == batch(spark, rows, 0.5, 1) and set(first) < set(got)
    frames_kept = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "kept").load()
    assert frames_kept.count() == len(got)  # one entry a page


def test_new_session_removal_and_ends(spark, tmp_path):
    at = lambda k: START + timedelta(seconds=k)
    h = [7, 7]
    rows = [
        ("a", 1, at(1), h, None, None), ("a", 2, at(2), h, None, None), ("a", 3, at(3), h, True, None),  # begun anew: kept again, number 1
        ("a", 4, at(4), None, None, None), ("a", 5, at(5), None, None, 3), ("a", 6, at(6), h, None, None),  # page 3 goes, its like comes back
        ("b", 1, at(1), h, None, None), ("b", None, at(2), [99, 99], None, None), ("b", 9, None, [99, 99], None, None),
    ]
    put(spark, tmp_path / "in", rows)
    got = run(spark, tmp_path, gap=0.5, threshold=1)
    assert [(s, i, n) for s, i, _, n in got] == [("a", 1, 1), ("a", 3, 1), ("a", 6, 2), ("b", 1, 1)]
    with pytest.raises(ValueError):
        sessions.session_pages(spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in")), 1.0, delay="1 second", ttl_ms=5)


def test_state_ends_after_its_time(spark, tmp_path):
    h = [5, 5]
    put(spark, tmp_path / "in", [("a", 1, START, h, None, None)])
    run(spark, tmp_path, gap=0.5, threshold=1, ttl_ms=1)
    time.sleep(0.2)
    put(spark, tmp_path / "in", [("a", 2, START + timedelta(seconds=9), h, None, None)])
    assert [(i, n) for _, i, _, n in run(spark, tmp_path, gap=0.5, threshold=1, ttl_ms=1)] == [(1, 1), (2, 1)]


def test_camera_lead(spark, tmp_path):
    rows = [("a", k, START + timedelta(seconds=k), [1 << 3 * k, 0], None, None) for k in range(5)]
    put(spark, tmp_path / "in", rows)
    got = run(spark, tmp_path, gap=12.0, threshold=0, camera=True)
    assert [i for _, i, _, _ in got] == [2]  # the last frame counts as taken ten seconds before the first
