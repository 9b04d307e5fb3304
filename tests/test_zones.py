"""Range scans through a zone map: the rows of a plain filter, from few files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.sources import zones


def test_few_files_are_read(spark, tmp_path):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1000).alias("at"))
    path = f"file://{tmp_path}/z"
    zones.write_zoned(rows.filter("id < 3000"), path, "at", files=16)
    zones.write_zoned(rows.filter("id >= 3000"), path, "at", files=4)
    for low, high in ((100, 130), (0, 1), (990, 5000), (0, 1000), (500, 500), (-9, -1)):
        got = zones.read_zoned(spark, path, "at", F.lit(low), F.lit(high))
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.filter(f"at >= {low} AND at < {high}").collect())
    assert len(zones.read_zoned(spark, path, "at", F.lit(100), F.lit(130)).inputFiles()) <= 4 < 20 == zones.zones(spark, path).count()
    assert zones.zones(spark, path).agg(F.sum("rows"), F.sum("nulls")).first()[:] == (4000, 80)


def test_one_hot_key_is_cut(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit(5).alias("at"))
    zones.write_zoned(rows, f"file://{tmp_path}/z", "at", files=4, rows_a_file=100)
    held = zones.zones(spark, f"file://{tmp_path}/z").collect()
    assert len(held) >= 10 and max(r["rows"] for r in held) <= 100
    assert zones.read_zoned(spark, f"file://{tmp_path}/z", "at", F.lit(5), F.lit(6)).count() == 1000


def test_nothing_there(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        zones.read_zoned(spark, f"file://{tmp_path}/none", "at", F.lit(1), F.lit(2))
