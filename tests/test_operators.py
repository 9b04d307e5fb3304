"""Greedy folds, detection, matching, page lists, evaluation, export and snapshots."""

from __future__ import annotations

import random
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from foliant.operators import detection, evaluate, export, folds, matching, pages
from foliant.sources import media, session


def test_dedup_leader_and_boundary(spark):
    rows = spark.createDataFrame([("s", i, [h]) for i, h in enumerate((0b00000000, 0b00000011, 0b00001111))], "k string, i int, h array<long>")
    kept = folds.greedy_dedup(rows, ["k"], [F.col("i")], "h", 2, ["i"]).collect()
    assert sorted(r.i for r in kept) == [0, 2]
    said = {r.i: (r.nearest_id, r.distance, r.is_duplicate) for r in folds.nearest_kept(rows, ["k"], [F.col("i")], "h", "i", 2).collect()}
    assert said == {0: (None, None, False), 1: (0, 2, True), 2: (0, 4, False)}


def test_dedup_property(spark):
    rng = random.Random(3)
    data = [(i % 3, i, [rng.getrandbits(12), rng.getrandbits(3)]) for i in range(90)]
    rows = spark.createDataFrame(data, "k int, i int, h array<long>")
    kept = {r.i for r in folds.greedy_dedup(rows, ["k"], [F.col("i")], "h", 4, ["i"]).collect()}
    dist = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b))
    for k, i, h in data:
        before = [x for j, x in [(j, x) for kk, j, x in data if kk == k and j < i and j in kept]]
        assert (i in kept) == all(dist(h, x) > 4 for x in before)


@pytest.mark.parametrize("second, keep", [((0, 5, 10, 10, 0.8), True), ((0, 2, 10, 10, 0.7), False), ((0, 0, 10, 20, 0.8), False)])
def test_nms_goldens(spark, second, keep):
    rows = spark.createDataFrame([("p", 0, 0, 0, 10, 10, 0.9), ("p", 1, *second)], "p string, i int, x int, y int, width int, height int, c double")
    kept = {r.i for r in folds.greedy_nms(rows, ["p"], "c", ["i"], 0.5, ["i"]).collect()}
    assert kept == ({0, 1} if keep else {0})


def test_gap_sample(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate((0.0, 0.3, 0.5, 0.9, 1.0, 1.6))], "s string, i int, t double")
    assert sorted(r.t for r in folds.gap_sample(rows, ["s"], "t", 0.5, ["i"]).collect()) == [0.0, 0.5, 1.0, 1.6]


def test_empty_groups(spark):
    rows = spark.createDataFrame([], "s string, i int, t double, h array<long>")
    assert folds.gap_sample(rows, ["s"], "t", 0.5, ["i"]).count() == 0
    assert folds.greedy_dedup(rows, ["s"], [F.col("i")], "h", 2, ["i"]).count() == 0


def test_detection_order(spark):
    raw = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 100.0, 100.0, 0.9, 1), (1, 1, 10.0, 100.0, 90.0, 150.0, 0.8, 2), (1, 2, 0.0, 0.0, 5.0, 5.0, 0.9, 2), (1, 3, 0.0, 0.0, 50.0, 50.0, 0.29, 2),
         (1, 4, 0.0, 0.0, 50.0, 50.0, float("nan"), 2), (1, 5, 0.0, 0.0, 50.0, 50.0, 0.9, 8)],
        "page int, i int, x1 double, y1 double, x2 double, y2 double, score double, class_id int",
    ).withColumns({"img_w": F.lit(800), "img_h": F.lit(600)})
    got = {r.i: (r.kind, r.x, r.y, r.box_w, r.box_h) for r in detection.boxes(raw).collect()}
    assert got == {0: ("block", 0, 0, 100, 100), 1: ("line", 10, 99, 80, 52), 4: ("line", 0, 0, 50, 51)}
    lines, blocks = detection.postprocess(raw, "page", "i")
    assert {r.i for r in lines.collect()} == {1, 4} and blocks.count() == 1


def test_coverage_boundary(spark):
    rows = spark.createDataFrame([(p, i, 1 if i < n else None) for p, n in ((1, 7), (2, 6)) for i in range(10)], "p int, i int, b int")
    assert {r.p: r.falls_back for r in matching.coverage(rows, "p", "b").collect()} == {1: False, 2: True}


def page_list(spark, n=5):
    return spark.createDataFrame([("s", i + 1, f"p{i + 1}") for i in range(n)], "session string, position int, page_id string")


def ids(df):
    return [r.page_id for r in df.orderBy("position").collect()]


def test_page_edits(spark):
    p = page_list(spark)
    gone = spark.createDataFrame([("s", "p2")], "session string, page_id string")
    assert ids(pages.remove(p, gone, "session", "page_id")) == ["p1", "p3", "p4", "p5"]
    assert ids(pages.swap_with_previous(p, F.lit(3))) == ["p1", "p3", "p2", "p4", "p5"]
    assert ids(pages.swap_with_previous(p, F.lit(1))) == ids(p) == ids(pages.move_down(p, F.lit(5)))
    order = lambda *x: spark.createDataFrame([("s", list(x))], "session string, ids array<string>")
    assert ids(pages.reorder(p, order("p5", "p4", "p3", "p2", "p1"), "session", "page_id")) == ["p5", "p4", "p3", "p2", "p1"]
    assert ids(pages.reorder(p, order("p5", "p4", "p3", "p2"), "session", "page_id")) == ids(p)
    assert pages.clear(p).count() == 0 and pages.append(p, p).count() == 10
    assert [r.error for r in pages.cap(p, 4).orderBy("position").collect()] == [None] * 4 + ["page-limit-exceeded"]


def test_batches(spark):
    p = page_list(spark, 23)
    sizes = p.groupBy(pages.batch_key("batch", F.col("position"), 10).alias("k")).count().orderBy("k").collect()
    assert [r["count"] for r in sizes] == [10, 10, 3]
    with pytest.raises(ValueError):
        pages.batch_key("other", F.col("position"))


def test_summary_rounds_first(spark):
    rows = spark.createDataFrame([("s", True, 1.04, 1.0), ("s", False, 1.04, 2.0)], "s string, detected boolean, sharpness double, detect_ms double")
    r = evaluate.summary(rows, ["s"]).first()
    assert (r.total, r.found, r.rate, r.mean_sharpness) == (2, 1, 50.0, 1.0)


def test_every_kth(spark):
    rows = spark.range(40).withColumnRenamed("id", "i")
    assert evaluate.every_kth(rows, "i", 0, 0.5).count() == 3
    with pytest.raises(ValueError):
        evaluate.every_kth(rows, "i", 1.0, 0.5)


def test_stability(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate((1.0, 1.1, 9.0, 9.1, 9.05))], "s string, i int, v double")
    got = [r.state for r in evaluate.stability(rows, ["s"], "i", "v", 0.5).orderBy("i").collect()]
    assert got == ["unknown", "stable", "moving", "stable", "stable"]


def test_pdf(spark):
    jpeg = b"\xff\xd8\xff\xd9"
    rows = spark.createDataFrame([("s", i + 1, bytearray(jpeg), 1200, 1600) for i in range(3)], "session string, position int, jpeg binary, width int, height int")
    got = export.export(rows, mode="batch", size=2)
    files = {r.file_no: bytes(r.pdf) for r in got.collect()}
    assert set(files) == {0, 1} and files[0].startswith(b"%PDF-") and files[0].count(b"/Type /Page ") == 2 and jpeg in files[1]
    with zipfile.ZipFile(io.BytesIO(bytes(export.archives(got).first().zip))) as z:
        assert z.namelist() == ["document-001.pdf", "document-002.pdf"]


def test_session_round_trip(spark, tmp_path):
    path = str(tmp_path / "session")
    assert session.load_session(spark, path).count() == 0
    p = spark.createDataFrame([(1, "a", "data:,", 3, 4), (2, "b", "data:,", 3, 4)], "position int, id string, data_url string, width int, height int").withColumn("captured_at", F.timestamp_millis(F.lit(5)))
    stored = pages.to_stored(p).join(p.select("id", "position"), "id")
    session.save_session(stored, path, now=F.timestamp_millis(F.lit(1000)))
    session.save_session(stored.filter("position = 1"), path, now=F.timestamp_millis(F.lit(2000)))
    got = session.session_pages(session.load_session(spark, path)).collect()
    assert [(r.position, r.id, r.sharpness) for r in got] == [(1, "a", 0.0)]
    session.clear_session(spark, path)
    assert session.load_session(spark, path).count() == 0


def test_charset_and_preferences(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('model:\n  charset_test: "ab"\n  charset_train: " !\\"#\\\\x"\n')
    assert media.charset(spark, str(tmp_path / "c.yaml")) == ' !"#\\x'
    stored = spark.createDataFrame([("model-config", "{bad"), ("document-language", "fr")], "key string, value string")
    assert tuple(media.preferences(stored).first()) == (False, "fr")


def test_earlier_distances_in_blocks(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i * 2, [rng.getrandbits(63) - (1 << 62), rng.getrandbits(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, h array<long>")
    bits = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
    want = {}
    for k, n, h in rows:
        near = [(bits(h, g), m) for j, m, g in rows if j == k and m < n]
        if near:
            want[k, n] = min(near)[::-1]
    for block in (7, 1024):
        got = {(r.k, r.n): (r.nearest_seq, r.distance) for r in matching.earlier_distances(df, ["k"], "n", "h", block).collect()}
        assert got == want
