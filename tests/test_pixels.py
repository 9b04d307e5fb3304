"""Images as columns agree with the numpy operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import pixels
from foliant.operators import images

W, H = 7, 5


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        quad = np.array([[0, 0], [W - 1, 0], [W - 1, H - 1], [0, H - 1]], float) + rng.uniform(-0.8, 0.8, (4, 2))
        rows.append((i, rng.integers(0, 256, W * H).astype(float).tolist(), quad.ravel().tolist(), int(rng.integers(-2, 6)), int(rng.integers(-2, 4))))
    return rows, spark.createDataFrame(rows, "id int, px array<double>, q array<double>, x int, y int").withColumn("img", pixels.image(F.col("px"), W, H))


def array(r):
    return np.array(r["pixels"]).reshape(r["height"], r["width"])


def test_against_numpy(made):
    rows, df = made
    quad = [(F.col("q")[2 * k], F.col("q")[2 * k + 1]) for k in range(4)]
    cut = pixels.crop(F.col("img"), F.col("x"), F.col("y"), F.lit(4), F.lit(3))
    out = df.select("id", pixels.warp(F.col("img"), pixels.square_to_quad(quad), 6, 9).alias("warp"), cut.alias("crop"), pixels.letterbox(F.col("img"), 10).alias("box"), pixels.turned(F.col("img")).alias("left"), pixels.normalised(F.col("img"), 100.0, 50.0).alias("norm"))
    got = {r["id"]: r for r in out.collect()}
    for i, px, q, x, y in rows:
        img = np.array(px).reshape(H, W)
        assert np.abs(array(got[i]["warp"]) - images.warp(img, np.array(q).reshape(4, 2), 6, 9)).max() <= 1
        assert (array(got[i]["crop"]) == images.crop(img, x, y, 4, 3)).all() and array(got[i]["crop"]).shape[1] == images.crop(img, x, y, 4, 3).shape[1]
        assert array(got[i]["box"]) == pytest.approx(images.letterbox(img, 10))
        assert (array(got[i]["left"]) == np.rot90(img)).all() and array(got[i]["norm"]) == pytest.approx((img - 100) / 50)


def test_odd_images(spark):
    df = spark.range(1).select(pixels.image(F.array(*[F.lit(9.0)] * 4), 2, 2).alias("img"))
    line = [(F.lit(float(k)), F.lit(float(k))) for k in range(4)]
    far = pixels.crop(F.col("img"), F.lit(5), F.lit(5), F.lit(2), F.lit(2))
    r = df.select(pixels.warp(F.col("img"), pixels.square_to_quad(line), 2, 2)["pixels"].alias("w"), far.alias("c"), pixels.letterbox(far, 2)["pixels"].alias("b"), pixels.turned(far)["pixels"].alias("t")).first()
    assert r["w"] is None and r["c"]["pixels"] == [] and r["c"]["width"] == 0 and r["b"] == [0.0] * 4 and r["t"] == []
