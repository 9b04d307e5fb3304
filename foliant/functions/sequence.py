"""Sequence expressions: softmax, argmax, token collapse, histograms' gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """0-based place of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_probability(scores: Column) -> Column:
    """Softmax probability of the largest score: 1 / sum(exp(s - max))."""
    below = F.zip_with(scores, F.array_repeat(F.array_max(scores), F.size(scores)), lambda s, top: F.exp(s.cast("double") - top.cast("double")))
    return 1.0 / F.aggregate(below, F.lit(0.0), lambda a, v: a + v)


def emitted_tokens(tokens: Column, charset_size: int, european: bool = False) -> Column:
    """tokens: array<struct<id,p>>. Class ids and probabilities up to the stop token.

    Japanese: 0 stops, ids under 4 are skipped, others mean class id - 1. European: the charset's size stops.
    """
    at = F.array_position(tokens["id"], charset_size if european else 0)
    head = F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)
    shift = 0 if european else 1
    used = head if european else F.filter(head, lambda t: t["id"] >= 4)
    return F.transform(used, lambda t: F.struct((t["id"] - shift).cast("int").alias("id"), t["p"].cast("double").alias("p")))


def collapsed(emitted: Column, charset_size: int) -> Column:
    """Drops ids outside the charset, then ids equal to the one kept before."""
    known = F.filter(emitted, lambda t: (t["id"] >= 0) & (t["id"] < charset_size))
    before = F.concat(F.array(F.lit(-1)), known["id"])
    pairs = F.filter(F.zip_with(known, before, lambda t, b: F.struct(t.alias("t"), b.alias("b"))), lambda x: x["t"].isNotNull() & (x["t"]["id"] != x["b"]))
    return F.transform(pairs, lambda x: x["t"])


def mean_confidence(kept: Column) -> Column:
    """Mean of the kept probabilities, 0 without any."""
    total = F.aggregate(kept["p"], F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0)


def decoded_text(kept: Column, charset: str) -> Column:
    """The kept ids' characters, joined and trimmed."""
    chars = F.split(F.lit(charset), "")
    return F.array_join(F.transform(kept, lambda t: F.element_at(chars, t["id"] + 1)), "")


def longest_minimum(hist: Column) -> Column:
    """struct<start,end,score>: the first longest run of the smallest value; score is -min/max.

    Histograms of one cell or none give (0, length, 0). One pass: a smaller value begins anew.
    """
    names = ("low", "high", "run", "best", "end", "i")
    make = lambda *v: F.struct(*[x.cast("int").alias(n) for n, x in zip(names, v)])
    start = make(F.lit(2**31 - 1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v < s["low"], 1).when(v == s["low"], s["run"] + 1).otherwise(0)
        best = F.when(v < s["low"], 0).otherwise(s["best"])
        return make(F.least(s["low"], v), F.greatest(s["high"], v), run, F.greatest(best, run), F.when(run > best, s["i"] + 1).otherwise(s["end"]), s["i"] + 1)

    def finish(s: Column) -> Column:
        short = s["i"] <= 1
        score = F.when(~short & (s["high"] > 0), -s["low"] / s["high"]).otherwise(0.0)
        return F.struct(
            F.when(short, 0).otherwise(s["end"] - s["best"]).alias("start"), F.when(short, s["i"]).otherwise(s["end"]).alias("end"), score.cast("double").alias("score")
        )

    return F.aggregate(hist, start, step, finish)
