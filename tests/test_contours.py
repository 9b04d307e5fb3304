"""Contours against plain flood fills, on random masks, concave sheets and nested regions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from foliant.operators import contours, images

MASKS = hnp.arrays(np.int8, st.tuples(st.integers(1, 9), st.integers(1, 9)), elements=st.integers(0, 1))
SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]
CORNERS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def flood(mask, steps):
    """Pixel by pixel: the region of every set pixel, from 1."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n, todo = n + 1, [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                    out[c, d] = n
                    todo.append((c, d))
    return out


def plain_areas(mask):
    """With holes filled, each square of four centres is in whole, by half (three set), or out."""
    ground = flood(np.pad(mask, 1) == 0, SIDES)
    filled = (ground != ground[0, 0])[1:-1, 1:-1]
    of = flood(filled, SIDES + CORNERS)
    areas = []
    for k in range(1, of.max() + 1):
        own = (of == k).astype(int)
        four = own[1:, 1:] + own[:-1, 1:] + own[1:, :-1] + own[:-1, :-1]
        areas.append(float((four == 4).sum() + (four == 3).sum() / 2))
    return areas


@settings(max_examples=400, deadline=None)
@given(MASKS)
def test_labels_and_areas(mask):
    assert (contours.labels(mask) == flood(mask, SIDES + CORNERS)).all()
    assert [contours.area(c) for c in contours.outer(mask)] == plain_areas(mask)


@settings(max_examples=200, deadline=None)
@given(MASKS)
def test_borders_are_borders(mask):
    for c in contours.outer(mask):
        assert mask[c[:, 1], c[:, 0]].all()
        step = np.abs(np.roll(c, -1, 0) - c).max(1)
        assert len(c) == 1 or (step == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=25))
def test_smallest_rectangle(points):
    pts = np.array(points)
    cx, cy, w, h, deg = contours.callipers(pts)
    c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
    turned = (pts - [cx, cy]) @ np.array([[c, -s], [s, c]])
    assert (np.abs(turned[:, 0]) <= w / 2 + 1e-6).all() and (np.abs(turned[:, 1]) <= h / 2 + 1e-6).all()
    best = np.inf
    own = contours.hull(pts)
    for a, b in zip(own, np.roll(own, -1, 0)):
        t = np.arctan2(*(b - a)[::-1])
        x = own @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        best = min(best, np.prod(x.max(0) - x.min(0)))
    assert w * h == pytest.approx(best, abs=1e-6)


def test_concave_sheet_is_judged_by_its_contour():
    mask = np.zeros((100, 100), np.int8)
    mask[10:90, 10:22] = mask[78:90, 10:90] = 1  # an L: its hull passes the gate of 0.3, its contour does not
    (c,) = contours.outer(mask)
    assert contours.area(contours.hull(c)) > 0.3 * mask.size > contours.area(c)
    assert contours.largest(mask, 0.3) is None and contours.largest(mask, 0.15) is not None


def test_nested_regions_have_no_outer_contour():
    mask = np.zeros((40, 40), np.int8)
    mask[2:38, 2:38], mask[5:35, 5:35], mask[10:20, 10:20] = 1, 0, 1
    (c,) = contours.outer(mask)
    assert contours.area(c) == 35 * 35


def test_long_diameter():
    """A spiral is one region, however long the way through it."""
    mask = np.zeros((301, 301), np.int8)
    a, b = 0, 300
    while a + 4 < b:
        mask[a, a : b + 1] = mask[a : b + 1, b] = mask[b, a + 2 : b + 1] = mask[a + 2 : b + 1, a + 2] = 1
        mask[a + 2, a + 2 : b - 1] = 1
        a, b = a + 2, b - 2
    assert contours.labels(mask).max() == flood(mask, SIDES + CORNERS).max()


def test_paper_in_a_frame():
    gray = np.full((120, 160), 40, np.uint8)
    gray[20:100, 30:140] = 220
    gray[55:65, 30:60] = 40  # a finger over the edge
    assert images.detect_quad(gray).round().tolist() == [[30, 20], [139, 20], [139, 99], [30, 99]]


def test_odd_masks(spark):
    rows = [(1, [1, 1, 1, 1]), (2, None), (3, []), (4, [1, 0, 1]), (5, [0, 0, 0, 0])]
    got = {r[0]: tuple(r)[1:] for r in contours.contour_stats(spark.createDataFrame(rows, "id int, m array<int>"), "id", "m", 2).collect()}
    assert got[1] == (1, 1.0, 1.0, 1.0) and all(got[k] == (0, 0.0, None, None) for k in (2, 3, 4, 5))
