"""Page lists: ordered rows (session, position from 1, page id) and their edits. Every edit returns a new list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def captured(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """pages with a new id (a random UUID) and captured_at (``now``, or this moment) in milliseconds."""
    stamp = F.unix_millis(F.current_timestamp() if now is None else now)
    return pages.withColumns({"id": F.uuid(), "captured_at": stamp})


def renumber(pages: DataFrame, session: str, order: list[str], name: str = "position") -> DataFrame:
    return pages.withColumn(name, F.row_number().over(W.partitionBy(session).orderBy(*order)).cast("int"))


def append(pages: DataFrame, new: DataFrame) -> DataFrame:
    return pages.unionByName(new)


def remove(pages: DataFrame, gone: DataFrame, session: str, page_id: str) -> DataFrame:
    """Without the pages of ``gone``; positions close up. The same on a dedup store lets a page be captured again."""
    left = pages.join(gone.select(session, page_id), [session, page_id], "left_anti")
    return renumber(left, session, ["position"])


def swap_with_previous(pages: DataFrame, k: Column) -> DataFrame:
    """The page at k and the one before it change places; nothing moves for k at or before the start, or past the end."""
    pos, n = F.col("position"), F.count(F.lit(1)).over(W.partitionBy("session"))
    moves = (k > 1) & (k <= n)
    return pages.withColumn("position", F.when(moves & (pos == k), pos - 1).when(moves & (pos == k - 1), pos + 1).otherwise(pos).cast("int"))


def move_down(pages: DataFrame, k: Column) -> DataFrame:
    return swap_with_previous(pages, k + 1)


def reorder(pages: DataFrame, wanted: DataFrame, session: str, page_id: str) -> DataFrame:
    """wanted: session, ids (array). A session takes the new order if its ids are the same multiset, and stays as it is otherwise.

    Equal ids keep their order among themselves: both sides number them.
    """
    have = pages.groupBy(session).agg(F.array_sort(F.collect_list(page_id)).alias("_have"))
    fits = wanted.join(have, session).filter(F.array_sort("ids") == F.col("_have"))
    nth = lambda order: F.row_number().over(W.partitionBy(session, page_id).orderBy(order))
    places = fits.select(session, F.posexplode("ids").alias("_p", page_id)).withColumn("_nth", nth("_p"))
    joined = pages.withColumn("_nth", nth("position")).join(places, [session, page_id, "_nth"], "left")
    return joined.withColumn("position", F.coalesce(F.col("_p") + 1, F.col("position")).cast("int")).drop("_p", "_nth")


def cap(pages: DataFrame, most: int = 200) -> DataFrame:
    """Every page with ``error``: page-limit-exceeded past the cap, else null."""
    return pages.withColumn("error", F.when(F.col("position") > most, "page-limit-exceeded"))


def clear(pages: DataFrame) -> DataFrame:
    return pages.limit(0)


def to_stored(pages: DataFrame) -> DataFrame:
    """The stored form: sharpness is always 0 and the recognised text is not filled."""
    lines = "array<struct<text:string,bbox:array<double>,confidence:double>>"
    return pages.select("id", "data_url", "width", "height", F.lit(0.0).alias("sharpness"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast(lines).alias("ocr_lines"), "captured_at")


def from_stored(stored: DataFrame) -> DataFrame:
    return stored.select("id", "data_url", "width", "height", "captured_at")


def assemble_text(lines: DataFrame, page: str, order: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """page, full_text: the non-empty texts in reading order."""
    kept = lines.filter(F.col(text) != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias("full_text"))


def ocr_lines(blocks: Column) -> Column:
    """array<struct<text,bbox,confidence>> of text blocks."""
    return F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), F.array(b["x"], b["y"], b["width"], b["height"]).alias("bbox"), b["confidence"].alias("confidence")))


def batch_key(mode: str, position: Column, size: int = 10) -> Column:
    """Which file of an export a page goes to."""
    if mode == "single":
        return F.lit(0)
    if mode == "split":
        return (position - 1).cast("int")
    if mode == "batch":
        return F.floor((position - 1) / size).cast("int")
    raise ValueError(f"mode {mode}")
