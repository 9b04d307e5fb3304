"""Nearest earlier hashes and leaders against brute force and against the folds, with hot groups, copies and chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import folds, hash_index

HASHES = "label string, seq long, words array<long>"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near_copies(n, centres, flips, seed=3, words=1, label=lambda i: "one"):
    rng = random.Random(seed)
    held = [[rng.getrandbits(64) for _ in range(words)] for _ in range(centres)]
    out = []
    for i in range(n):
        h = list(rng.choice(held))
        for _ in range(rng.randrange(flips + 1)):
            h[rng.randrange(words)] ^= 1 << rng.randrange(64)
        out.append((label(i), i * 3, [signed(x) for x in h]))
    rng.shuffle(out)
    return out


def distance(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


def plain_nearest(rows):
    out = set()
    for label, seq, h in rows:
        earlier = [(distance(h, g), s) for k, s, g in rows if k == label and s < seq]
        if earlier:
            d, s = min(earlier)
            out.add((label, seq, s, d))
    return out


@pytest.mark.parametrize("words,bands,reach", [(1, 4, 1), (1, 8, 2), (2, 8, 0)])
def test_nearest_earlier(spark, words, bands, reach):
    rows = near_copies(400, 40, 6, words=words, label=lambda i: [None, "a", "b"][min(2, i % 7)])
    rows += [("a", 5000 + k, [0] * words) for k in range(30)]  # copies of one hash
    df = spark.createDataFrame(rows, HASHES)
    got = hash_index.nearest_earlier(df, ["label"], "seq", "words", words, bands, reach, block=32).collect()
    assert {(r["label"], r["seq"], r["nearest_seq"], r["distance"]) for r in got} == plain_nearest(rows)
    assert len(got) == len(plain_nearest(rows))


def test_candidates_are_few(spark):
    rows = near_copies(3000, 600, 3)
    df = spark.createDataFrame(rows, HASHES)
    out = hash_index.nearest_earlier(df, ["label"], "seq", "words", reach=1).agg(F.sum("compared"), F.count("*")).first()
    assert out[1] == 2999
    assert out[0] < 0.35 * 3000 * 2999 / 2  # every row without a near one still meets all of its group: 600 of 3,000


def test_bands_that_do_not_fit():
    with pytest.raises(ValueError):
        hash_index.band_values(F.lit(None), 1, 5)
    assert len(hash_index.flips(16, 2)) == 120 and all(x.bit_count() == 2 for x in hash_index.flips(16, 2))


def by_fold(spark, df, threshold):
    out = folds.greedy_dedup(df, ["label"], [F.col("seq")], "words", threshold, ["seq"])
    return {(r["label"], r["seq"], r["ordinal"]) for r in out.collect()}


def found(df, threshold, block):
    rows = hash_index.leaders(df, ["label"], "seq", "words", threshold, block).collect()
    out = {(r["label"], r["seq"], r["ordinal"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_leaders_equal_fold(spark):
    rows = near_copies(500, 60, 8, label=lambda i: [None, "a", "hot", "hot"][i % 4]) + [("hot", 9000 + k, [77]) for k in range(20)]
    df = spark.createDataFrame(rows, HASHES)
    assert found(df, 6, 1024) == by_fold(spark, df, 6)
    assert found(df, 20, 16) == by_fold(spark, df, 20)  # many chunks, prefixes and rounds


def test_leaders_of_a_chain(spark):
    """Each row lies near the one before alone, so every decision hangs on the last."""
    h, rows = 0, []
    for k in range(60):
        h ^= 0b111 << 3 * (k % 20)
        rows.append(("c", k, [signed(h)]))
    df = spark.createDataFrame(rows, HASHES)
    assert found(df, 3, 8) == by_fold(spark, df, 3)


def test_leaders_odd(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, [5]), ("a", 2, [5]), (None, 3, [5])], HASHES)
    assert found(df, 3, 4) == {("a", 2, 1), (None, 3, 1)}
    assert found(df.limit(0), 3, 4) == set()
