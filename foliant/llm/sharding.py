"""Sharding by jump consistent hash (DataFrame functions only).

The 64-bit key of a row is the first half of the MD5 of its id as text (null: the word ``null``).
The jump runs the published recurrence: the key is multiplied modulo 2**64 by a fixed odd number, its top 31
bits choose how far the next jump leads, and the last place before the number of shards is the
shard. No ring table exists, and with one more shard a row either stays or goes to the new one.

Slots number the rows of a shard from 0 without gaps, in the order of (key, id, size, crc32). They are not
counted by one task per shard: rows are numbered within cells of a shard (the key's first 12
bits), and the cells' sums, 4,096 a shard at most, give each cell its first slot.

Defined results: null ids share one key and so one shard; repeated rows get slots of their own;
a null text has size 1 and crc32 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import table, text_of

#: Fixed values of the published recurrence.
JUMP_FACTOR = "2862933555777941757"
TWO_64 = "18446744073709551616"


def stable_key(id_col: str = "doc_id") -> Column:
    """Unsigned 64-bit key as decimal(20,0)."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a decimal(20,0) key.

    Every jump goes at least one place on, so ``shards`` steps always suffice; steps after the end
    leave the state as it is.
    """
    factor, modulus = F.lit(JUMP_FACTOR).cast("decimal(19,0)"), F.lit(TWO_64).cast("decimal(20,0)")
    start = F.struct(key.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = (F.pmod(s["k"] * factor + F.lit(1).cast("decimal(1,0)"), modulus)).cast("decimal(20,0)")
        top = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / top)).cast("long")
        on = s["j"] < shards
        return F.when(on, F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        stable_key(id_col).alias("key"),
    )
    rows = rows.withColumns({
        "shard": jump_shard(F.col("key"), shards),
        "grown_shard": jump_shard(F.col("key"), shards + 1),
        "cell": F.floor(F.col("key") / F.lit(1 << 52).cast("decimal(16,0)")).cast("int"),
    })
    cells = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    firsts = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "cell").orderBy("key", "id", "size", "crc")
    numbered = rows.withColumn("rn", F.row_number().over(within))
    return numbered.join(firsts, ["shard", "cell"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: crc32 has no function in the oracle; it is built there from its table, which a rule gives.
OP10_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 16))::UBIGINT AS key
  FROM documents
), ids AS (
  SELECT DISTINCT key FROM base
), jumps AS (
  SELECT key, n, key::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM ids, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT key, n, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT key, n, j, ((k // 4294967296 * 2862933555777941757 % 4294967296) * 4294967296
               + k % 4294967296 * 2862933555777941757 + 1) % 18446744073709551616 AS k2
        FROM jumps WHERE j < n)
), placed AS (
  SELECT key, max(b) FILTER (n = 8 AND j >= 8)::INTEGER AS shard, max(b) FILTER (n = 9 AND j >= 9)::INTEGER AS grown_shard
  FROM jumps GROUP BY key
), sized AS (
  SELECT doc_id, key, (octet_length(encode(text)) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295)::BIGINT AS crc
  FROM base, crc_table
)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot, grown_shard
FROM sized JOIN placed USING (key)
"""
