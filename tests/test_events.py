"""What the bus reports of a run equals what is computed from its rows."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from foliant.streaming import events, stateful

FRAMES = "id long, detected boolean, page boolean, sharpness double"


def parts(spark, folder, n=90, files=3):
    rows = [(i, i % 3 > 0, i % 10 == 0, float(i)) for i in range(n)]
    for k in range(files):
        spark.createDataFrame(rows[k * n // files : (k + 1) * n // files], FRAMES).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return rows


def stream(spark, folder):
    df = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return events.observed(df, F.col("detected"), F.col("page"), F.col("sharpness"))


def finish(bus, query):
    assert query.awaitTermination(60)
    assert bus.wait(str(query.runId))


def test_events_and_rows(spark, tmp_path):
    rows = parts(spark, tmp_path / "in")
    got = {e: [] for e in events.EVENTS}
    bus = events.EventBus(spark, total=90, path=f"file://{tmp_path}/progress").start()
    for e in events.EVENTS:
        bus.on(e, got[e].append)
    gone = []
    unsubscribe = bus.on("progress", gone.append)
    bus.on("progress", lambda p: 1 / 0)  # one that raises
    unsubscribe()
    unsubscribe()
    try:
        finish(bus, stateful.persist(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")))
    finally:
        bus.stop()
    assert [(p["batch"], p["done"], p["percent"]) for p in got["progress"] if p["batch"] < 3] == [(0, 30, 33), (1, 60, 67), (2, 90, 100)]
    assert sum(p["pages"] for p in got["page"]) == sum(r[2] for r in rows)
    assert got["quality"][:3] == [14.5, 44.5, 74.5]
    assert got["state"][0] == "active" and got["state"][-1] == "idle" and got["error"] == [] and gone == []
    assert bus.failures and all(isinstance(e, ZeroDivisionError) for e in bus.failures)
    table = events.progress_rows(spark, str(tmp_path / "progress"), 90).filter("frames > 0").sort("batch").collect()
    assert [(r["frames"], r["detected"], r["pages"], r["done"], r["percent"]) for r in table] == [(30, 20, 3, 30, 33), (30, 20, 3, 60, 67), (30, 20, 3, 90, 100)]


def test_errors_and_names(spark, tmp_path):
    parts(spark, tmp_path / "in", 9, 1)
    errors, states, other = [], [], []
    bus, deaf = events.EventBus(spark).start(), events.EventBus(spark, name="another").start()
    bus.on("error", errors.append)
    bus.on("state", states.append)
    deaf.on("state", other.append)
    bad = stream(spark, tmp_path / "in").withColumn("x", F.raise_error(F.lit("lens covered")))
    query = stateful.persist(bad, str(tmp_path / "out"), str(tmp_path / "ck"))
    try:
        with pytest.raises(Exception, match="lens covered"):
            query.awaitTermination(60)
        assert bus.wait(str(query.runId))
    finally:
        bus.stop()
        deaf.stop()
    assert len(errors) == 1 and "lens covered" in errors[0] and states == ["active", "error"] and other == []
    with pytest.raises(ValueError):
        bus.on("nothing", print)
