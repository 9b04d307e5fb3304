"""Stand-ins for scanner data, derived from the driver's tables; the SQL twins are text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.hashing import bits_to_words, hash_bits

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, rid, x, y, width, height, conf: an order is a page, a line item a box."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rid = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return items.select(
        F.col("l_orderkey").alias("page"), rid.alias("rid"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") + 20).alias("width"), (F.col("l_linenumber") + 12).cast("int").alias("height"),
        (F.floor("l_extendedprice") % 100).cast("int").alias("conf"),
    )


BOXES = """
boxes AS (
  SELECT l_orderkey AS page,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS rid,
    (l_partkey % 60)::INTEGER AS x, (l_suppkey % 40)::INTEGER AS y, 20 + trunc(l_quantity)::INTEGER AS width,
    (12 + l_linenumber)::INTEGER AS height, (floor(l_extendedprice)::BIGINT % 100)::INTEGER AS conf
  FROM lineitem)"""

#: Fixed values of the stand-in: overlapping blocks of every page, so that the first match matters.
BLOCKS = ((1, 0, 0, 40, 30), (2, 30, 0, 45, 40), (3, 20, 25, 40, 30))


def blocks(spark: SparkSession, pages: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("block_id", "x", "y", "width", "height"), b)]) for b in BLOCKS])
    return pages.select("page").distinct().select("page", F.explode(each).alias("b")).select("page", "b.*")


BLOCKS_SQL = "blocks(block_id, bx, b_y, bw, bh) AS (VALUES " + ", ".join(map(str, BLOCKS)) + ")"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id, bits, words: vectors as 8 x 8 grey images, hashed."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return v.withColumn("bits", hash_bits(F.col("embedding"))).withColumn("words", bits_to_words(F.col("bits"), SIDE * SIDE)).drop("embedding")


HASHES = """
hashes AS (
  SELECT label, vec_id, list_aggregate(list_transform(embedding, lambda v:
    CASE WHEN v::DOUBLE > list_sum(list_transform(embedding, lambda u: u::DOUBLE)) / 64 THEN '1' ELSE '0' END), 'string_agg', '') AS bits
  FROM embeddings)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, event_id, ts, idx (from 0 by time over all), detected, sharpness."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), "event_id", "ts", (F.col("event_type") != "error").alias("detected"), F.col("value").alias("sharpness"), "event_type")


FRAMES = """
frames AS (
  SELECT user_id AS session, event_id, ts, event_type <> 'error' AS detected, value AS sharpness, event_type FROM events)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, position from 1, page_id, text: a conversation is a page list."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), (F.col("turn") + 1).cast("int").alias("position"), F.concat_ws("-", "conv_id", "turn").alias("page_id"), "text", "role")


PAGES = """
plist AS (
  SELECT conv_id AS session, (turn + 1)::INTEGER AS position, conv_id || '-' || turn AS page_id, text, role FROM conversations)"""
