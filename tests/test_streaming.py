"""Streams give what the batch folds give for the same ordered input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.operators import folds
from foliant.streaming import stateful

SCHEMA = "session string, id long, ts timestamp, hash array<long>"


def write_parts(spark, tmp_path, n=60, parts=3):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(f"s{i % 2}", i, start + timedelta(seconds=i * rng.choice([0.2, 0.3])), [rng.getrandbits(6)]) for i in range(n)]
    rows.sort(key=lambda r: r[2])
    for k in range(parts):
        spark.createDataFrame(rows[k * n // parts : (k + 1) * n // parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    stateful.persist(df, str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
    return {r.id for r in df.sparkSession.read.parquet(str(tmp_path / name)).select("id").collect()}


def test_throttle_equals_batch(spark, tmp_path):
    batch = write_parts(spark, tmp_path, parts=1)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    want = {r.id for r in folds.gap_sample(batch, ["session"], "ts", 2.0, ["id"], ["id"]).collect()}
    assert run(stateful.throttle(stream, 2.0), tmp_path, "out") == want


def test_dedup_equals_batch(spark, tmp_path):
    batch = write_parts(spark, tmp_path, parts=1)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    want = {r.id for r in folds.greedy_dedup(batch, ["session"], [F.col("ts"), F.col("id")], "hash", 1, ["id"]).collect()}
    assert run(stateful.dedup(stream, 1, 1), tmp_path, "out") == want


def test_adaptive_gap():
    assert stateful.adaptive_gap("idle") == 0.2 and stateful.adaptive_gap("active") == 0.1 and stateful.adaptive_gap("active", 60) == 1 / 15
