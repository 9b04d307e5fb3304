"""Order-dependent greedy operators as folds over one group's ordered array, inside the JVM.

A group is a session or a page, so its size is bounded by what one session or page holds, not by the table.
Each fold gathers only order keys and payload, and explodes what it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import iou
from foliant.functions.hashing import hamming


def _grouped(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """keys, items: the group's rows in the order of ``order``, each as struct<ord,payload...>."""
    row = F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("ord"), *payload)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))


def _kept(items: Column, accepts, dtype: str) -> Column:
    """The items that ``accepts(item, kept so far)`` takes, in order."""
    start = F.expr(f"cast(array() as {dtype})")
    return F.aggregate(items, start, lambda kept, item: F.when(accepts(item, kept), F.concat(kept, F.array(item))).otherwise(kept))


def _fold(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], accepts) -> DataFrame:
    grouped = _grouped(df, keys, order, payload)
    dtype = grouped.schema["items"].dataType.simpleString()
    out = grouped.select(*keys, F.posexplode(_kept(F.col("items"), accepts, dtype)).alias("pos", "item"))
    return out.select(*keys, *[F.col(f"item.{c}").alias(c) for c in payload], (F.col("pos") + 1).cast("int").alias("ordinal"))


def greedy_dedup(df: DataFrame, keys: list[str], order: list[Column], words: str, threshold: int = 60, payload: list[str] = ()) -> DataFrame:
    """Leader clustering: a row stays if it is further than ``threshold`` bits from every row kept before it."""
    far = lambda item, kept: F.forall(kept, lambda k: hamming(k[words], item[words]) > threshold)
    return _fold(df, keys, order, [*payload, words], far)


def nearest_kept(df: DataFrame, keys: list[str], order: list[Column], words: str, id_col: str, threshold: int = 60) -> DataFrame:
    """Every row with the decision on it: is_duplicate, and nearest_id and distance among the rows kept before (first of equals)."""
    grouped = _grouped(df, keys, order, [id_col, words])
    item = grouped.schema["items"].dataType.simpleString()
    id_type = df.schema[id_col].dataType.simpleString()
    made = f"array<struct<id:{id_type},near:{id_type},dist:int,dup:boolean>>"
    start = F.struct(F.expr(f"cast(array() as {item})").alias("kept"), F.expr(f"cast(array() as {made})").alias("out"))

    def step(s: Column, it: Column) -> Column:
        best = F.array_min(F.transform(s["kept"], lambda k, i: F.struct(hamming(k[words], it[words]).alias("d"), i.alias("i"), k[id_col].alias("id"))))
        dup = F.coalesce(best["d"] <= threshold, F.lit(False))
        said = F.struct(it[id_col].alias("id"), best["id"].alias("near"), best["d"].alias("dist"), dup.alias("dup"))
        return F.struct(F.when(dup, s["kept"]).otherwise(F.concat(s["kept"], F.array(it))).alias("kept"), F.concat(s["out"], F.array(said)).alias("out"))

    out = grouped.select(*keys, F.explode(F.aggregate("items", start, step)["out"]).alias("o"))
    return out.select(*keys, F.col("o.id").alias(id_col), F.col("o.near").alias("nearest_id"), F.col("o.dist").alias("distance"), F.col("o.dup").alias("is_duplicate"))


def greedy_nms(df: DataFrame, keys: list[str], confidence: str, tie: list[str], threshold: float = 0.5, payload: list[str] = ()) -> DataFrame:
    """Non-maximum suppression of boxes x, y, width, height: by falling confidence, a box stays if its IoU
    with every kept box is under ``threshold``."""

    def apart(it: Column, kept: Column) -> Column:
        box = lambda b: (b["x"], b["y"], b["width"], b["height"])
        return F.forall(kept, lambda k: iou(*box(k), *box(it)) < threshold)

    names = list(dict.fromkeys([*payload, confidence, "x", "y", "width", "height"]))
    return _fold(df, keys, [-F.col(confidence), *[F.col(t) for t in tie]], names, apart)


def gap_sample(df: DataFrame, keys: list[str], ts: str, gap: float, tie: list[str] = (), payload: list[str] = ()) -> DataFrame:
    """Throttle: a row is taken if it is ``gap`` seconds or more after the last taken one; the first always is.

    ts is a timestamp or a number of seconds.
    """
    kind = df.schema[ts].dataType.simpleString()
    at = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else (F.col(ts).cast("double") * 1e6).cast("long")
    df = df.withColumn("_at", at)
    names = list(dict.fromkeys([*payload, ts]))
    grouped = _grouped(df, keys, [F.col("_at"), *[F.col(t) for t in tie]], [*names, "_at"])
    item = grouped.schema["items"].dataType.simpleString()
    last = lambda kept: F.try_element_at(kept, F.lit(-1))["_at"]
    takes = lambda it, kept: F.coalesce(it["_at"] - last(kept) >= round(gap * 1e6), F.lit(True))
    out = grouped.select(*keys, F.posexplode(_kept(F.col("items"), takes, item)).alias("pos", "item"))
    return out.select(*keys, *[F.col(f"item.{c}").alias(c) for c in names], (F.col("pos") + 1).cast("int").alias("ordinal"))
