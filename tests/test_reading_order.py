"""Reading order: goldens, properties, and a plain version on a grid laid out cell by cell, over all pages of the tables."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators.reading_order import emptiest_run, page_order, reading_order, stretches
from foliant.plans import catalog
from foliant.plans import fixtures as fx

boxes = st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(1, 80), st.integers(1, 80)), min_size=1, max_size=25)


def order(*b):
    return page_order([tuple(map(float, x)) for x in b])


def plain_run(hist):
    """(start, end, score): the first longest run of the smallest value."""
    if len(hist) <= 1:
        return 0, len(hist), 0.0
    low, best = min(hist), (0, 0)
    for i in range(len(hist)):
        j = i
        while j < len(hist) and hist[j] == low:
            j += 1
        if j - i > best[1] - best[0]:
            best = i, j
    return *best, -low / max(hist) if max(hist) else 0.0


def plain_ranks(rects):
    """Recursion on a grid of cells, as the definition says it."""
    n = len(rects)
    if n < 2:
        return [0] * n
    r = np.array(rects, float)
    low, high = r[:, :2].min(0), r[:, 2:].max(0)
    extent = high - low
    if extent.all():
        side = 100 * extent / extent.max()
        w, h = (int(v) + 1 for v in np.ceil(side))
        first = np.maximum(0, np.floor((r[:, :2] - low) * side / extent)).astype(int)
        last = np.minimum([w - 1, h - 1], np.ceil((r[:, 2:] - low) * side / extent)).astype(int)
        cells = np.hstack([first, np.maximum(first + 1, last)])
    else:
        cells, w, h = np.tile([0, 0, 1, 1], (n, 1)), 2, 2
    grid = np.zeros((h, w), int)
    for x0, y0, x1, y1 in cells:
        grid[y0:y1, x0:x1] = 1

    def tree(x0, y0, x1, y1):
        part = grid[y0:y1, x0:x1]
        xs, ys = plain_run(part.sum(0).tolist()), plain_run(part.sum(1).tolist())
        node = {"box": (x0, y0, x1, y1), "parts": [], "by_x": False, "lines": []}
        if xs[:2] == (0, x1 - x0) and ys[:2] == (0, y1 - y0):
            return node
        node["by_x"] = xs[2] > ys[2] or xs[2] == ys[2] and xs[1] - xs[0] >= ys[1] - ys[0]
        run, base, end = (xs, x0, x1) if node["by_x"] else (ys, y0, y1)
        at = [base, base + run[0], base + run[1], end]
        for a, b in zip(at, at[1:]):
            box = (a, y0, b, y1) if node["by_x"] else (x0, a, x1, b)
            if a < b and box != node["box"]:
                node["parts"].append(tree(*box))
        return node

    root = tree(0, 0, w, h)
    leaves = []

    def walk(node):
        if node["parts"]:
            for p in node["parts"]:
                walk(p)
        else:
            leaves.append(node)

    walk(root)
    for i, (x0, y0, x1, y1) in enumerate(cells.tolist()):
        shares = []
        for leaf in leaves:
            a, b, c, d = leaf["box"]
            inter = max(0, min(x1, c) - max(x0, a)) * max(0, min(y1, d) - max(y0, b))
            shares.append(inter / ((x1 - x0) * (y1 - y0) + (c - a) * (d - b) - inter))
        leaves[shares.index(max(shares))]["lines"].append(i)
    upright = [x1 - x0 < y1 - y0 for x0, y0, x1, y1 in cells.tolist()]
    mostly = lambda ids: len(ids) < 2 * sum(upright[i] for i in ids)

    def read(node):
        if node["lines"]:
            key = (lambda i: (-cells[i][0], cells[i][1])) if mostly(node["lines"]) else (lambda i: (cells[i][1], cells[i][0]))
            return sorted(node["lines"], key=key)
        runs = [read(p) for p in node["parts"]]
        if node["by_x"] and mostly([i for run in runs for i in run]):
            runs.reverse()
        return [i for run in runs for i in run]

    out = [0] * n
    for k, i in enumerate(read(root)):
        out[i] = k
    return out


def plain_order(lines, blocks=()):
    rects = [(x, y, x + w, y + h) for x, y, w, h in lines]
    n = len(lines)
    inside = lambda r, b: b[0] <= r[0] + (r[2] - r[0]) / 2 <= b[0] + b[2] and b[1] <= r[1] + (r[3] - r[1]) / 2 <= b[1] + b[3]
    of = [next((k for k, b in enumerate(blocks) if inside(r, b)), None) for r in rects]
    if n < 2 or not blocks or sum(k is not None for k in of) < 0.7 * n:
        return [k + 1 for k in plain_ranks(rects)]
    groups = [[i for i in range(n) if of[i] == k] for k in dict.fromkeys(of) if k is not None] + [[i] for i in range(n) if of[i] is None]
    outer = plain_ranks([tuple(f(rects[i][c] for i in g) for f, c in ((min, 0), (min, 1), (max, 2), (max, 3))) for g in groups])
    flat = []
    for k in sorted(range(len(groups)), key=lambda k: outer[k]):
        inner = plain_ranks([rects[i] for i in groups[k]])
        flat += [groups[k][j] for j in sorted(range(len(inner)), key=lambda j: inner[j])]
    return [flat.index(i) + 1 for i in range(n)]


def test_all_pages_equal_the_plain_version(spark, sf):
    held: dict = {}
    for r in fx.boxes(spark, sf).collect():
        held.setdefault(r.page, []).append((r.rid, (float(r.x), float(r.y), float(r.width), float(r.height))))
    blocks = [tuple(map(float, b[1:])) for b in fx.BLOCKS]
    for name, with_blocks in (("reading_order_lines", ()), ("reading_order_blocks", blocks)):
        got = {(r.page, r.rid): r.reading_order for r in catalog.QUERIES[name](spark, sf).collect()}
        want = {}
        for page, items in held.items():
            items.sort()
            want |= {(page, i): k for (i, _), k in zip(items, plain_order([b for _, b in items], with_blocks))}
        assert got == want


@settings(max_examples=150, deadline=None)
@given(boxes, boxes)
def test_equals_the_plain_version(b, blocks):
    lines = [tuple(map(float, x)) for x in b]
    assert page_order(lines) == plain_order(lines)
    big = [(x, y, w * 4.0, h * 4.0) for x, y, w, h in blocks[:4]]
    assert page_order(lines, big) == plain_order(lines, big)


def test_goldens():
    assert order((0, 0, 40, 10), (0, 20, 40, 10), (60, 0, 40, 10), (60, 20, 40, 10)) == [1, 2, 3, 4]
    assert order((0, 0, 10, 100), (30, 0, 10, 100)) == [2, 1]
    assert order((5, 5, 10, 10)) == [1]
    assert page_order([]) == []
    assert order((5, 5, 0, 0), (5, 5, 0, 0)) == [1, 2]


def test_emptiest_run():
    def run(hist):
        return emptiest_run([(i, i + 1, (1 << n) - 1) for i, n in enumerate(hist)], 0, len(hist), 0, 8)

    assert run([3, 0, 0, 2, 0, 0, 1]) == (1, 3, 0.0)
    assert run([2, 2]) == (0, 2, -1.0)
    assert run([5]) == (0, 1, 0.0)
    assert stretches([(0, 0, 2, 3), (1, 1, 4, 2)], 0, 5) == [(0, 1, 7), (1, 2, 7), (2, 4, 2), (4, 5, 0)]


@settings(max_examples=150, deadline=None)
@given(boxes, st.integers(-50, 50), st.integers(0, 3))
def test_permutation_translation_scaling(b, shift, power):
    a = np.array(b, float)
    got = page_order(a.tolist())
    assert sorted(got) == list(range(1, len(a) + 1))
    assert page_order((a + [shift, shift, 0, 0]).tolist()) == got
    assert page_order((a * 2**power).tolist()) == got


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_one_block_of_all_is_plain(b):
    a = np.array(b, float).tolist()
    assert page_order(a, [(-1.0, -1.0, 1000.0, 1000.0)]) == page_order(a)


def test_blocks_and_spark(spark):
    lines = [(1, 1, 0, 0, 40, 10, 0.9, "a"), (1, 2, 60, 0, 40, 10, 0.9, "b"), (1, 3, 0, 20, 40, 10, 0.9, "c"), (1, 4, 0, 40, 40, 10, 0.05, "d"), (1, 5, 0, 60, 40, 10, 0.9, "　 ")]
    df = spark.createDataFrame(lines, "page int, i int, x int, y int, width int, height int, confidence double, text string")
    assert {r.i: r.reading_order for r in reading_order(df, "page", "i").collect()} == {1: 1, 3: 2, 2: 3}
    blocks = spark.createDataFrame([(1, 1, 50, 0, 60, 30), (1, 2, 0, 0, 45, 80)], "page int, block_id int, x int, y int, width int, height int")
    assert sorted(r.reading_order for r in reading_order(df, "page", "i", blocks).collect()) == [1, 2, 3]
