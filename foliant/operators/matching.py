"""Join-shaped operators: nearest hashes, first containing block, coverage, positional and priority matches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import contains
from foliant.shipping import ship

BLOCK = 1024


def earlier_distances(df: DataFrame, keys: list[str], seq: str, words: str, block: int = BLOCK) -> DataFrame:
    """keys, seq, nearest_seq, distance: of all earlier rows of the group the nearest, first of equals. seq: integers.

    Every row meets every earlier one, but no pair becomes a row: a group's rows are dealt into blocks of about ``block``, two blocks meet
    in one task, and of them each row hands on its best. Work inside a group is thus spread over tasks of one size.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, F.col(seq).cast("long").alias("_seq"), F.col(words).alias("_w"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = rows.join(sizes.withColumnsRenamed({k: f"_k{k}" for k in keys}), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("_seq"), F.col("_n")).cast("int"))
    held = dealt.groupBy(*keys, "_n", "_b").agg(F.collect_list(F.struct("_seq", "_w")).alias("_rows"))
    sides = F.col("_rows")["_seq"], F.flatten(F.col("_rows")["_w"])
    mine = held.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_to"), sides[0].alias("_s"), sides[1].alias("_h"))
    others = held.select(*[F.col(k).alias(f"_o{k}") for k in keys], F.col("_b").alias("_ob"), sides[0].alias("_os"), sides[1].alias("_oh"))
    met = mine.join(others, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys)) & (F.col("_to") == F.col("_ob")))
    met = met.select(*keys, "_s", "_h", "_os", "_oh")
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, h, os, oh = (batch.column(at + k)[i].values.to_numpy() for k in range(4))
                h, oh = h.view(np.uint64).reshape(len(s), -1), oh.view(np.uint64).reshape(len(os), -1)
                order = np.argsort(os, kind="stable")
                os, oh = os[order], oh[order]
                d = np.zeros((len(s), len(os)), np.int32)
                for k in range(h.shape[1]):
                    d += np.bitwise_count(h[:, k, None] ^ oh[None, :, k])
                d[os[None, :] >= s[:, None]] = np.iinfo(np.int32).max
                best = d.argmin(1)
                found = d[np.arange(len(s)), best]
                keep = np.flatnonzero(found < np.iinfo(np.int32).max)
                names = pa.array(np.full(len(keep), i))
                yield pa.RecordBatch.from_arrays([*(c.take(names) for c in batch.columns[:at]), pa.array(s[keep]), pa.array(found[keep]), pa.array(os[best[keep]])], [*keys, "_s", "_d", "_o"])

    schema = df.select(*keys).schema.add("_s", "long").add("_d", "integer").add("_o", "long")
    best = F.min(F.struct("_d", "_o"))
    kind = df.schema[seq].dataType
    nearest = met.mapInArrow(run, schema).groupBy(*keys, "_s").agg(best.alias("_m"))
    return nearest.select(*keys, F.col("_s").cast(kind).alias(seq), F.col("_m._o").cast(kind).alias("nearest_seq"), F.col("_m._d").alias("distance"))


def assign_blocks(lines: DataFrame, blocks: DataFrame, page: str, line_id: str, block_id: str) -> DataFrame:
    """lines with the first block (smallest block_id) that holds the line's centre, null if none does.

    A page's blocks are few, so they ride along as one array: no pairs of lines and blocks are made.
    """
    b = blocks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(block_id, "x", "y", "width", "height"))).alias("_blocks"))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = F.filter("_blocks", lambda k: contains(cx, cy, k["x"], k["y"], k["width"], k["height"]))
    return lines.join(b, page, "left").withColumn(block_id, F.try_element_at(inside, F.lit(1))[block_id]).drop("_blocks")


def coverage(assigned: DataFrame, page: str, block_id: str, least: float = 0.7) -> DataFrame:
    """page, assigned, total, falls_back: under ``least`` of the lines in blocks?"""
    n, total = F.count(block_id), F.count(F.lit(1))
    return assigned.groupBy(page).agg(n.alias("assigned"), total.alias("total"), (n < least * total).alias("falls_back"))


def group_extents(assigned: DataFrame, page: str, block_id: str) -> DataFrame:
    """Outer rectangle of each block's own lines."""
    return assigned.filter(F.col(block_id).isNotNull()).groupBy(page, block_id).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1")
    )


def zip_positions(left: DataFrame, right: DataFrame, page: str, pos: str) -> DataFrame:
    return left.join(right, [page, pos])


def first_known(*backends: Column) -> Column:
    """The first backend that found something."""
    return F.coalesce(*backends)


def largest_within(df: DataFrame, keys: list[str], area: str, order: str, frame_area: Column, low: float = 0.15, high: float = 0.97) -> DataFrame:
    """keys, order, area of the largest area inside the gate, first of equals."""
    gated = df.filter(F.col(area).between(frame_area * low, frame_area * high))
    best = F.min(F.struct((-F.col(area)).alias("a"), F.col(order).alias("o")))
    return gated.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.o").alias(order), (-F.col("m.a")).alias(area))
