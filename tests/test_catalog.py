"""Every query with SQL gives the SQL's rows; the entry module works with and without the optional parts."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

import __spark_entry__
from foliant.plans import capture, catalog

BOTH = catalog.QUERIES | capture.QUERIES
SQL = catalog.ORACLES | capture.ORACLES


def text(v):
    if v is None or v != v:
        return "NULL"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(BOTH))
def test_query(spark, sf, oracle, name):
    df = BOTH[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in SQL:
        rel = oracle.sql(SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        want = sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
        assert len(got) == len(want)
        assert [g for g, w in zip(got, want) if g != w][:3] == []


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: 3 * i + 5, lambda i: 5000 * i])
def test_sample_dedup_uses_every_vector(spark, tmp_path, ids):
    """900 vectors, more than event_id % 500 reaches, all far apart, with and without gaps: each takes part."""
    from datetime import datetime, timedelta

    rng = random.Random(3)
    vectors = [(ids(i), 0, [rng.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(900)]
    events = [(e, 1, datetime(2024, 1, 1) + timedelta(hours=6 * e), "view", 1.0) for e in range(900)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    words = {r.vec_id: r.words for r in catalog.fx.hashes(spark, tmp_path).collect()}
    kept, want = [], []
    for e in range(900):
        h = words[ids(e)]
        if all(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(h, k)) > catalog.DEDUP_BITS for k in kept):
            kept.append(h)
            want.append(e)
    got = sorted(r.event_id for r in catalog.QUERIES["stream_sample_dedup"](spark, str(tmp_path)).collect())
    assert got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["label", "vec_id", "page_no"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
