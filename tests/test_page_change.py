"""Page change detectors: order, reset between sessions, batches, and the states as columns over ranges."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant.operators import matching
from foliant.operators.page_change import FrameDifference, frame_changes, page_changes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
FRAME = "session string, n long, pixels binary, width int, height int, channels int"


class Counting:
    """Numbers the frames since the last reset; every third one moves."""

    def reset(self):
        self.n = 0

    def process(self, image):
        self.n += 1
        return "unknown" if self.n == 1 else "moving" if self.n % 3 == 0 else "stable"


class Wrong(Counting):
    def process(self, image):
        return "asleep"


def frames(spark, rows):
    made = [(s, n, None if px is None else bytearray(px), 2, 2, 1) for s, n, px in rows]
    return spark.createDataFrame(made, FRAME)


def plain(rows, threshold):
    """Session by session in order, as lists."""
    out, before = {}, {}
    for s, n, px in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or "", r[1])):
        old = before.get(s)
        gap = None if old is None else sum(abs(a - b) for a, b in zip(px, old)) / len(px)
        out[s, n] = "unknown" if gap is None else "stable" if gap <= threshold else "moving"
        before[s] = px
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    made = [("hot", n) for n in range(300)] + [("b", n) for n in range(5)] + [(None, n) for n in range(4)] + [("one", 0)]
    made = [(s, n, rng.integers(0, 40, 4).tolist() if rng.random() < 0.9 else None) for s, n in made]
    return [made[i] for i in rng.permutation(len(made))]


def test_detector_sees_sessions_in_order(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = frames(spark, rows).repartition(5)
        got = {(r.session, r.n): r.state for r in page_changes(df, lambda: FrameDifference(12.0), ["session"], ["n"]).collect()}
        assert got == plain(rows, 12.0) and set(got.values()) == {"unknown", "stable", "moving"}
        counted = {(r.session, r.n): r.state for r in page_changes(frames(spark, [("a", i, [0] * 4) for i in range(6)]), Counting, ["session"], ["n"]).collect()}
        assert [counted["a", i] for i in range(6)] == ["unknown", "stable", "moving", "stable", "stable", "moving"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_over_ranges(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "session string, n long, px array<int>").repartition(6)
        got = {(r.session, r.n): r.state for r in frame_changes(df, ["session"], ["n"], "px", 12.0).collect()}
        assert got == plain(rows, 12.0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    other = spark.createDataFrame([("s", 0, [1, 2]), ("s", 1, [1, 2, 3]), ("s", 2, [1, 2, 3])], "session string, n long, px array<int>")
    assert {r.n: r.state for r in frame_changes(other, ["session"], ["n"], "px").collect()} == {0: "unknown", 1: "moving", 2: "stable"}


def test_empty_and_wrong_answers(spark):
    none = frames(spark, [])
    assert page_changes(none, Counting, ["session"], ["n"]).collect() == []
    assert frame_changes(none.select("session", "n", F.array(F.lit(1)).alias("px")), ["session"], ["n"], "px").collect() == []
    with pytest.raises(Exception, match="asleep"):
        page_changes(frames(spark, [("a", 0, [0] * 4)]), Wrong, ["session"], ["n"]).collect()


def test_positions_and_fallbacks(spark):
    left = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "page string, pos int, box string")
    right = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y")], "page string, pos int, line string")
    assert [tuple(r) for r in matching.zip_positions(left, right, "page", "pos").collect()] == [("p", 1, "a", "x")]
    row = spark.range(1).select(matching.first_known(F.lit(None).cast("int"), F.lit(0), F.lit(5)), matching.first_known(F.lit(None), F.lit(None))).first()
    assert tuple(row) == (0, None)
