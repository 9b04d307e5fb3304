"""Pluggable backends and the facade, with small stand-in models; recognition gates and decoding; snapshots."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant.functions import sequence
from foliant.operators import backends, evaluate, images, pages, recognition
from foliant.scanner import Scanner
from foliant.sources import session
from foliant.streaming import stateful

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
FRAME = "session string, frame_idx long, ts double, ready_state int, width int, height int, channels int, pixels binary"


class Model:
    """Knows whether it was warmed up; every answer depends on the image's mean."""

    def warm_up(self):
        self.warm = True

    def detect(self, image):
        assert self.warm and image.shape[2] == 3
        return None if image.mean() < 10 else [(1, 1), (6, 1), (6, 6), (1, 6)]

    def score(self, image):
        return image.mean() / 255, 0.5, 1.0

    def classify(self, image):
        return (True, None, 0.9) if image.mean() >= 100 else (False, "too dark" if image.mean() > 20 else None, 0.2)

    def recognise(self, image):
        if image.mean() < 10:
            raise ValueError("blank")
        return "line", image.mean() / 255


class Layout(Model):
    def detect(self, image):
        return [(0, 0, 300, 200, 0.9, 2), (0, 400, 300, 600, 0.8, 2, 12), (0, 0, 800, 800, 0.9, 1)]


def shades(spark, values):
    rows = [("s", i, float(i), 4 if v is not None else 1, 8, 8, 1, None if v is None else bytearray([v] * 64)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, FRAME)


def test_backends(spark):
    frames = shades(spark, [0, 50, 200, None])
    quads = {r.frame_idx: r.quad for r in backends.detect_edges(frames, Model).collect()}
    assert quads[0] is None and quads[1].br.x == 6.0 and 3 not in quads
    scores = {r.frame_idx: r.quality for r in backends.score_quality(frames, Model).collect()}
    assert abs(scores[2].overall - (0.5 * 200 / 255 + 0.25 * 0.5 + 0.25)) < 1e-9
    said = {r.frame_idx: (r.accepted, r.reason) for r in recognition.classified(backends.classify(frames, Model)).collect()}
    assert said == {0: (False, "not-a-document"), 1: (False, "too dark"), 2: (True, None)}
    boxes = backends.detect_layout(frames.filter("frame_idx = 2"), Layout).orderBy("box").collect()
    assert [(r.box, r.class_id, r.char_count, r.img_w) for r in boxes] == [(0, 2, 100, 8), (1, 2, 12, 8), (2, 1, 100, 8)]
    read = {r.frame_idx: (r.text, r.confidence) for r in backends.recognise(frames, Model).collect()}
    assert read[0] == ("", 0.0) and read[2][0] == "line"
    assert [r.frame_idx for r in recognition.confident(backends.recognise(frames, Model)).collect()] == [2]


def test_scanner(spark):
    rng = np.random.default_rng(2)
    pictures = [rng.integers(0, 2, 64, np.uint8) * 200 + 40 for _ in range(4)]
    rows = [("s", i, i * 0.3, 4, 8, 8, 1, bytearray(pictures[i // 4].tobytes())) for i in range(16)] + [("s", 99, 9.0, 1, 8, 8, 1, bytearray(64))]
    scan = Scanner(width=32, height=32, edges=Model, classifier=Model, threshold=30, most_pages=3)
    got = scan.pages(spark.createDataFrame(rows, FRAME)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1)) and [r.error for r in got][3:] == ["page-limit-exceeded"] * (len(got) - 3)
    assert {r.frame_idx // 4 for r in got} == {0, 1, 2, 3} and 99 not in {r.frame_idx for r in got}
    whole = {r.frame_idx: r for r in scan.scan(spark.createDataFrame(rows, FRAME)).collect()}
    assert {(i, r.position) for i, r in whole.items()} == {(r.frame_idx, r.position) for r in got if r.error is None}
    quad = np.array([(1, 1), (6, 1), (6, 6), (1, 6)], float)
    for i, r in whole.items():
        assert bytes(r.pixels) == images.warp(images.image_of(rows[i][7], 8, 8, 1), quad, 32, 32).tobytes() and (r.width, r.height, r.channels) == (32, 32, 3)
    plain = Scanner(width=32, height=32, edges=Model, threshold=30, most_pages=3).pages(spark.createDataFrame(rows, FRAME))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got))  # without a classifier pages go through one pass
    reader = Scanner(layout=Layout, recogniser=Model)
    page = spark.createDataFrame([("p", 8, 8, 3, bytearray([90] * 192))], "page string, width int, height int, channels int, pixels binary")
    crop = lambda p, lines: lines.select("page", "box").join(p, "page")
    assert [(r.page, r.full_text) for r in reader.text(page, crop).collect()] in ([], [("p", "line\nline")])


def test_decode_equals_expressions(spark):
    rng = random.Random(4)
    charset = "abcdefgh漢😀"
    rows = [(i, [rng.randrange(0 if rng.random() < 0.3 else 1, 16) for _ in range(rng.randrange(0, 12))]) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "i long, ids array<int>").withColumn("p", F.transform("ids", lambda x: 1.0 / (x + 1.0))).withColumn("decoded", F.lit(0))
    for european in (False, True):
        got = {r.i: (r.decoded, round(r.confidence, 9)) for r in recognition.decode(df, "ids", "p", charset, european).collect()}
        tokens = F.transform(F.arrays_zip("ids", "p"), lambda z: F.struct(z["ids"].alias("id"), z["p"].alias("p")))
        kept = sequence.collapsed(sequence.emitted_tokens(tokens, len(charset), european), len(charset))
        want = df.filter("ids IS NOT NULL").select("i", sequence.decoded_text(kept, charset).alias("t"), sequence.mean_confidence(kept).alias("c"))
        assert got.pop(999) == ("", 0.0) and got == {r.i: (r.t, round(r.c, 9)) for r in want.collect()}
    assert recognition.decode(df.filter("false"), "ids", "p", charset).count() == 0


def test_reorder_with_repeated_ids(spark):
    rows = [("s", 1, "a", 0), ("s", 2, "a", 1), ("s", 3, "b", 2), ("t", 1, "a", 3)]
    df = spark.createDataFrame(rows, "session string, position int, page string, n int")
    wanted = spark.createDataFrame([("s", ["b", "a", "a"]), ("t", ["b"])], "session string, ids array<string>")
    got = sorted((r.session, r.position, r.page, r.n) for r in pages.reorder(df, wanted, "session", "page").collect())
    assert got == [("s", 1, "b", 2), ("s", 2, "a", 0), ("s", 3, "a", 1), ("t", 1, "a", 3)]


def test_captured_and_texts(spark):
    df = pages.captured(spark.range(3).select(F.lit("x").alias("id")), F.lit(datetime(2024, 1, 1)).cast("timestamp"))
    rows = df.collect()
    assert len({r.id for r in rows}) == 3 and {r.captured_at for r in rows} == {1704067200000}
    out = spark.range(1).select(evaluate.seconds_text(F.lit(12.34)).alias("t"), *[c.alias(k) for k, c in recognition.line_summary(F.array(F.lit(1), F.lit(2)), F.lit(10.5)).items()]).first()
    assert (out.t, out.line_count, out.duration) == ("12.3s", 2, 11)
    sharp = evaluate.sharp_enough(spark.createDataFrame([(99.0,), (100.0,), (None,)], "sharpness double"))
    assert [r.sharpness for r in sharp.collect()] == [100.0]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert session.load_session(spark, path).count() == 0
    typed = spark.createDataFrame([], session.SESSION).select(F.explode("pages").alias("p")).select("p.*").schema
    one = spark.createDataFrame([("p1", "data:", 10, 20, 0.0, None, None, datetime(2024, 1, 1))], typed).withColumn("position", F.lit(1))
    at = lambda h: F.lit(datetime(2024, 1, 1, h)).cast("timestamp")
    for key in ("current", "other"):
        session.save_session(one, path, key, at(1))
    session.clear_session(spark, path, "current", at(2))
    assert session.load_session(spark, path).count() == 0 and session.load_session(spark, path, "other").count() == 1
    session.save_session(one, path, "current", at(3))
    assert session.session_pages(session.load_session(spark, path)).select("id").first()[0] == "p1"
    (tmp_path / "s" / "part-broken.parquet").write_bytes(b"not parquet")
    assert session.load_session(spark, path).count() == 0
    prefs = str(tmp_path / "p")
    for value, h in (("a", 1), ("b", 2)):
        session.save_preference(spark, prefs, "k", value, at(h))
    assert [(r.key, r.value) for r in session.saved_preferences(spark, prefs).collect()] == [("k", "b")]
    models = str(tmp_path / "m")
    spark.createDataFrame([("m", b"x", datetime(2024, 1, 1), "v1")], session.MODEL).write.parquet(models)
    session.clear_models(spark, models)
    assert spark.read.schema(session.MODEL).parquet(models).count() == 0
    asked, told = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2, "ok")], "id int, text string")
    assert {r.id: (r.answered, r.text) for r in session.correlated(asked, told).collect()} == {1: (False, None), 2: (True, "ok")}


def test_stream_starts_gaps_and_timeout(spark, tmp_path):
    # with a timeout there is always another batch to run: without data none is run here
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    start = datetime(2024, 1, 1)
    schema = "session string, id long, ts timestamp, hash array<long>, session_start boolean, state string"
    rows = [("s", i, start + timedelta(seconds=s), [0], b, state) for i, (s, b, state) in enumerate([(0, False, "idle"), (0.3, False, "active"), (0.35, True, "active"), (0.5, False, "idle"), (0.7, False, None)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        stateful.persist(df, str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).select("id").collect())

    assert run(stateful.throttle(stream(), 1.0), "plain") == [0, 2]
    assert run(stateful.throttle(stream(), 20.0, camera=True), "camera") == []
    assert run(stateful.throttle(stateful.adaptive_gaps(stream(), "state"), 1.0, gap_col="gap", ttl_ms=60_000), "adaptive") == [0, 1, 2, 4]
    assert run(stateful.dedup(stream(), 1, 1, ttl_ms=60_000), "dedup") == [0, 2]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    allowed = stateful.PIPELINE_TRANSITIONS
    steps = spark.createDataFrame([("s", 1, "idle"), ("s", 2, "active"), ("s", 3, "idle"), ("s", 4, "capturing")], "session string, n int, state string")
    said = {r.n: r.valid for r in evaluate.transitions(steps, ["session"], ["n"], "state", allowed).collect()}
    assert said == {1: True, 2: True, 3: True, 4: False}
