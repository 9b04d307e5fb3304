"""Pixel operators on drawn images."""

from __future__ import annotations

import numpy as np

from foliant.operators import images


def sheet(h=120, w=160, y0=20, y1=100, x0=30, x1=130):
    img = np.full((h, w), 30, np.uint8)
    img[y0:y1, x0:x1] = 220
    return img


def test_otsu_and_morphology():
    assert 30 <= images.otsu(sheet()) < 220
    dot = np.zeros((40, 40), np.int64)
    dot[20, 20] = 1
    assert images.close_open(dot).sum() == 0
    assert images.dilate(dot, 5).sum() == 25


def test_detect_quad_and_gate():
    q = images.detect_quad(sheet())
    assert np.abs(q - [[30, 20], [129, 20], [129, 99], [30, 99]]).max() <= 1.5
    assert images.detect_quad(sheet(y0=50, y1=70, x0=50, x1=70)) is None


def test_warp_and_homography():
    src, dst = np.array([[0, 0], [10, 0], [10, 20], [0, 20]], float), np.array([[1, 2], [30, 5], [28, 44], [3, 40]], float)
    m = images.homography(src, dst)
    p = np.c_[src, np.ones(4)] @ m.T
    assert np.allclose(p[:, :2] / p[:, 2:], dst)
    flat = images.warp(np.repeat(sheet()[..., None], 3, 2), np.array([[30, 20], [130, 20], [130, 100], [30, 100]], float), 50, 40)
    assert flat.shape == (40, 50, 3) and (flat[2:-2, 2:-2] == 220).all()


def test_tensors():
    rgb = np.full((20, 40, 3), 128, np.uint8)
    t = images.layout_tensor(rgb)
    assert t.shape == (1, 3, 800, 800) and t.dtype == np.float32 and np.isclose(t[0, 0, 799, 799], -123.675 / 58.395)
    assert images.line_tensor(rgb, 256, 16).shape == (1, 3, 16, 256)
    assert np.isclose(images.line_tensor(rgb.transpose(1, 0, 2), 128, 32, european=True)[0, 0, 0, 0], (128 / 255 - 0.694) / 0.299)
    assert images.crop(rgb, 5, 5, 10, 4).shape == (4, 10, 3) and len(images.crops(rgb, np.array([[0, 0, 2, 2]]))) == 1


def test_sharpness_and_thumbnail():
    assert images.sharpness(np.ones((8, 8))) == 0
    assert images.thumbnail(np.full((33, 50, 3), 10.0)).shape == (16, 16)


def test_frames_to_pages(spark):
    rows = [("s", 0, bytearray(sheet().tobytes()), 160, 120, 1), ("s", 1, bytearray(bytes(160 * 120)), 160, 120, 1), ("s", 2, None, 0, 0, 1)]
    frames = spark.createDataFrame(rows, "session string, idx int, pixels binary, width int, height int, channels int")
    found = images.detect(frames)
    flat = images.thumbnails(images.rectify(found, 32, 32))
    got = flat.collect()
    assert [r.idx for r in got] == [0] and len(got[0].luma) == 256 and found.count() == 2
