"""Hand-worked cases of the column functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foliant.functions import geometry, hashing, sequence, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_js_round(spark):
    got = spark.createDataFrame([(-0.5,), (2.5,), (-1.5,)], "v double").select(geometry.js_round(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 3, -1]


def test_iou_boundaries(spark):
    box = lambda *v: [F.lit(x) for x in v]
    r = one(spark, geometry.iou(*box(0, 0, 10, 10), *box(0, 0, 10, 20)), geometry.iou(*box(0, 0, 10, 10), *box(20, 0, 10, 10)), geometry.iou(*box(0, 0, 10, 10), *box(0, 5, 10, 10)))
    assert r[0] == 0.5 and r[1] == 0.0 and abs(r[2] - 50 / 150) < 1e-12


def test_contain_fit(spark):
    assert tuple(one(spark, geometry.contain_fit(F.lit(1200), F.lit(1600), 210, 297))[0]) == (210.0, 280.0, 0.0, 8.5)


def test_ordered_quad_first_of_equals(spark):
    pts = F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((5, 0), (10, 5), (5, 10), (0, 5))])
    q = one(spark, geometry.ordered_quad(pts).alias("q")).q
    assert (q.tl.x, q.tl.y) == (5, 0) and (q.br.x, q.br.y) == (10, 5)


def test_quad_validity(spark):
    pts = lambda ps: F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ps])
    square, bow = ((0, 0), (10, 0), (10, 10), (0, 10)), ((0, 0), (10, 10), (10, 0), (0, 10))
    r = one(spark, geometry.quad_valid(pts(square), F.lit(1000.0)), geometry.quad_valid(pts(bow), F.lit(100.0)), geometry.quad_valid(pts(square), F.lit(1001.0)))
    assert tuple(r) == (True, False, False)


def test_homography_apply(spark):
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 3, -1, 0, 0, 1)])
    p = one(spark, geometry.homography_apply(m, F.lit(4.0), F.lit(5.0)))[0]
    assert (p.x, p.y) == (9.0, 14.0)


def test_hash_flat_and_words(spark):
    r = one(spark, hashing.hash_bits(F.array(*[F.lit(3.0)] * 8)).alias("flat"), hashing.bits_to_words(F.array(*[F.lit(int(i in (0, 63, 64))) for i in range(70)]), 70).alias("w"))
    assert r.flat == [0] * 8
    assert r.w == [1 - (1 << 63), 1]
    assert one(spark, hashing.hash_hex(F.array(F.lit(10).cast("long"), F.lit(255).cast("long"))))[0] == "00000000000000ff000000000000000a"


def test_hamming(spark):
    a, b = F.array(F.lit(0b1011).cast("long"), F.lit(-1).cast("long")), F.array(F.lit(0b0001).cast("long"), F.lit(0).cast("long"))
    assert one(spark, hashing.hamming(a, b))[0] == 66


def tokens(ids):
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(0.5).alias("p")) for i in ids])


def test_decode_goldens(spark):
    charset = " !\"#$%&'()"
    for ids, want in (((5, 5, 4, 0, 7), "$#"), ((5, 2, 5, 0), "$"), ((0, 5), ""), ((5, 99, 5), "$")):
        kept = sequence.collapsed(sequence.emitted_tokens(tokens(ids), len(charset)), len(charset))
        assert one(spark, sequence.decoded_text(kept, charset))[0] == want
    kept = sequence.collapsed(sequence.emitted_tokens(tokens((1, 1, 2, 10, 3)), 10, european=True), 10)
    assert one(spark, sequence.decoded_text(kept, charset))[0] == '!"'
    assert one(spark, sequence.mean_confidence(sequence.emitted_tokens(tokens((0,)), 10)))[0] == 0.0


def test_softmax(spark):
    s = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    r = one(spark, sequence.argmax(s), sequence.top_probability(s))
    assert r[0] == 1 and abs(r[1] - 1 / (2 + math.exp(-2))) < 1e-12


def test_longest_minimum(spark):
    for hist, want in (([3, 0, 0, 2, 0, 0, 1], (1, 3, 0.0)), ([2, 2], (0, 2, -1.0)), ([7], (0, 1, 0.0)), ([0, 0], (0, 2, 0.0))):
        got = tuple(one(spark, sequence.longest_minimum(F.array(*[F.lit(v) for v in hist])))[0])
        assert got == want


def test_text_helpers(spark):
    r = one(
        spark,
        text.unicode_trim(F.lit("　 a b ﻿")), text.cache_key(F.lit("en"), F.lit("layout")), text.cache_key(F.lit("ja"), F.lit("layout")), text.cache_key(F.lit(None).cast("string"), F.lit("x")),
        text.model_config(F.lit('{"mathEnabled": true}')), text.model_config(F.lit("{broken")), text.document_language(F.lit("xx")), text.content_length(F.lit("12x")),
        text.data_url_payload(text.data_url(F.lit(b"abc"))), text.recogniser(F.lit(3), F.lit("european")), text.model_url(F.lit("mathDecoder"), F.lit("ja"), F.lit(True)),
    )
    assert list(r) == ["a b", "en:layout", "layout", "x", True, False, "ja", 0, b"abc", "recognitionEuropean", "/models/ocr/mfr-decoder.onnx"]
