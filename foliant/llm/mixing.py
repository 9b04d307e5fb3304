"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sizes are words. Sources sorted by code point (null last) weigh 1, 2, 3, repeating, and share all
words; no source gives more than 3 times its words, and what it can't give is shared again by
weight among the others until none is above.

A source's rate is target / words. Its whole part is taken of every document for certain. The rest is a sample of fixed size (in words) with
unequal probabilities: a document's weight is its class, the number of binary digits of its size, and its inclusion probability is ``p =
level * weight``, where the source's level makes the expected words meet what is left of the target. Classes for which that reaches 1 are taken
for certain, as one more whole copy, and the level is found again without them. With a uniform u that depends on id and text alone, documents
rank by ``(u/(1-u)) / (p/(1-p))``, and the smallest ranks are taken while their words come nearest to what is left.

A source may hold a third of all rows, so no task sorts a source. Ranks fall into cells; sums by (source, cell), taken before any shuffle of
rows, tell the one cell in which the source's sample ends, and only that cell's documents are put in order. Tables by source and class are
joined with a salt. Sources may be many: they are put in order by ranges, and the level at which they share is found by sums over all
of them, a few times.

Defined results: a null text has size 0 and is never lost from the result; sources without words have target
0; repeated rows are ranked side by side, ties by id and text; an empty table gives no rows; columns of any names may be there, and those
asked for with ``keep`` stay unless the result has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import staged, table, text_of, word_count

LIMIT = 3
CELLS = 4096
SALTS = 16


def uniform(id_col: str, text_col: str, seed: str = "mix") -> Column:
    """A number in (0, 1) from the id and the text, the same in every run: 52 bits of an MD5."""
    ident = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary")))
    bits = F.conv(F.substring(F.md5(ident.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def numbered(per: DataFrame, source: str) -> DataFrame:
    """per (one row for each source) with place, from 0 in the order of code points, null last; ranges of sources are numbered side by side."""
    order = [F.col(source).isNull(), F.col(source)]
    ranged = per.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "mix-sources")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    firsts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.join(firsts, "_part").withColumn("place", F.col("_first") + inside - 1).drop("_part", "_first")


def targets(sized: DataFrame, source: str = "source", size: str = "size", cycle: int = 3) -> DataFrame:
    """source, source_size, target: one row per source.

    The level at which sources share is found by rounds: those whose limit lies at or below their share stop, and the others share
    what is left. Only two sums a round reach the driver; a round without news ends it.
    """
    per = sized.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    per = numbered(per, source).select(source, "source_size", (F.col("place") % cycle + 1).alias("w"), (F.col("source_size") * LIMIT).alias("most"))
    per = staged(per, "mix-weights")
    total, weights = per.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = (float(total) / float(weights) if weights else 0.0), -1
    while True:
        stops = F.col("most").cast("double") <= F.lit(level) * F.col("w")
        n, most, w = per.filter(stops).agg(F.count(F.lit(1)), F.sum("most"), F.sum("w")).first()
        if n == stopped or n == 0 or w == weights:
            break
        level, stopped = float(total - most) / float(weights - w), n
    stops = F.col("most").cast("double") <= F.lit(level) * F.col("w")
    return per.select(source, "source_size", F.when(stops, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def plan(sums: DataFrame) -> DataFrame:
    """source, class, source_size, target, whole (copies for certain), p (inclusion probability of one more) and left (words to sample).

    sums: _source, _class, words; windows run over a source's classes, 32 at most for sizes that fit an int.
    """
    aims = targets(sums, "_source", "words").withColumnRenamed("_source", "s")
    per = sums.join(aims, F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(LIMIT), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    per = per.withColumn("base", rate).withColumn("rest", F.col("target") - (F.col("base") * F.col("source_size")).cast("double"))
    heavy = W.partitionBy("_source").orderBy(F.desc("_class"))
    ahead, behind = heavy.rowsBetween(W.unboundedPreceding, -1), heavy.rowsBetween(0, W.unboundedFollowing)
    certain = F.coalesce(F.sum("words").over(ahead), F.lit(0)).cast("double")
    share = F.sum(F.col("words") * F.col("_class")).over(behind).cast("double")
    # the level if exactly the heavier classes are certain
    per = per.withColumn("level", F.when(share > 0, (F.col("rest") - certain) / share).otherwise(0.0)).withColumn("left", F.col("rest") - certain)
    per = per.withColumn("sure", F.col("level") * F.col("_class") >= 1)
    all_of = W.partitionBy("_source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = F.max(F.when(~F.col("sure"), F.struct(F.col("_class"), "level", "left"))).over(all_of)
    per = per.withColumn("found", found)
    p = F.when(F.col("sure"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("found")["level"] * F.col("_class")))
    return per.select(
        "_source", "_class", "source_size", "target", (F.col("base") + F.col("sure").cast("long")).alias("whole"), p.alias("p"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("found")["left"], F.lit(0.0))).alias("left"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: str = "mix") -> DataFrame:
    """id_col, size, source_size, target, p, copies and taken (copies * size), and the columns ``keep``."""
    own = (id_col, "size", "source_size", "target", "p", "copies", "taken")
    keep = tuple(c for c in keep if c not in own)
    size = word_count(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), uniform(id_col, text_col, seed).alias("_u"), F.struct(F.lit(0), *[F.col(c) for c in keep]).alias("_row")
    )
    # binary digits of the size
    rows = rows.withColumn("_class", F.when(F.col("_size") > 0, F.char_length(F.bin("_size"))).otherwise(0).cast("long")).withColumn("_salt", F.floor(F.col("_u") * SALTS).cast("int"))
    sums = rows.groupBy("_source", "_class").agg(F.sum("_size").alias("words"))
    aims = staged(plan(staged(sums, "mix-sums")), "mix-plan")
    salted = aims.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"_source": "s", "_class": "c"})
    ranked = rows.join(salted, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")) & (F.col("_salt") == F.col("salt"))).drop("s", "c", "salt")
    odds = lambda x: x / (F.lit(1.0) - x)
    ranked = ranked.withColumn("_rank", F.when(F.col("p") > 0, odds(F.col("_u")) / odds(F.col("p"))))
    # documents that no sample takes have no rank and no cell
    ranked = ranked.withColumn("_cell", F.floor(F.col("_rank") / (F.lit(1.0) + F.col("_rank")) * CELLS).cast("int"))
    cells = ranked.filter("_cell IS NOT NULL").groupBy("_source", "_cell").agg(F.sum("_size").alias("words"), F.first("left").alias("left"))
    ahead = W.partitionBy("_source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    side = F.when(F.col("before") + F.col("words") <= F.col("left"), 1).when(F.col("before") >= F.col("left"), -1).otherwise(0)
    cells = cells.select(F.col("_source").alias("s"), F.col("_cell").alias("c"), "before", side.alias("side"))
    joined = ranked.join(cells, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_cell") == F.col("c")), "left").withColumn("side", F.coalesce("side", F.lit(-1)))
    ended = W.partitionBy("_source").orderBy("_rank", "_id", "_u").rowsBetween(W.unboundedPreceding, -1)
    edge = joined.filter("side = 0")
    edge = edge.withColumn("_run", F.col("before") + F.coalesce(F.sum("_size").over(ended), F.lit(0)))
    edge = edge.withColumn("extra", ((F.col("_run") + F.col("_size") / F.lit(2.0)) <= F.col("left")).cast("long"))
    rest = joined.filter("side <> 0").withColumn("extra", (F.col("side") > 0).cast("long"))
    names = ["_id", "_size", "source_size", "target", "p", "whole", "extra", "_row"]
    both = rest.select(*names).unionByName(edge.select(*names))
    copies = F.col("whole") + F.col("extra")
    return both.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "p",
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"), *[F.col("_row")[c].alias(c) for c in keep],
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "p")


OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS r, source, z, w, false AS stops, (SELECT sum(z) FROM per)::DOUBLE / (SELECT sum(w) FROM per)::DOUBLE AS level FROM per
  UNION ALL
  SELECT r + 1, source, z, w, stop2,
    ((SELECT sum(z) FROM per) - coalesce(sum(3 * z) FILTER (stop2) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT stop2) OVER ())::DOUBLE
  FROM (SELECT r, source, z, w, level, stops, stops OR (3 * z)::DOUBLE <= level * w AS stop2 FROM rounds)
  WHERE r < 60
), aims AS (
  SELECT source, z AS source_size, CASE WHEN stops THEN (3 * z)::DOUBLE ELSE level * w END AS target
  FROM rounds WHERE r = 60
), classed AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS class FROM sized
), sums AS (
  SELECT source, class, sum(size)::BIGINT AS words FROM classed GROUP BY source, class
), bases AS (
  SELECT c.source, class, words, source_size, target, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS base
  FROM sums c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source
), rests AS (
  SELECT *, target - (base * source_size)::DOUBLE AS rest FROM bases
), levels AS (
  SELECT *, coalesce(sum(words) OVER ahead, 0)::DOUBLE AS certain, (sum(words * class) OVER behind)::DOUBLE AS share
  FROM rests
  WINDOW ahead AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), sures AS (
  SELECT *, CASE WHEN share > 0 THEN (rest - certain) / share ELSE 0 END AS level, rest - certain AS remains,
    (CASE WHEN share > 0 THEN (rest - certain) / share ELSE 0 END) * class >= 1 AS sure
  FROM levels
), plan AS (
  SELECT source, class, source_size, target, base + sure::BIGINT AS whole,
    CASE WHEN sure THEN 0 ELSE greatest(0::DOUBLE, max_by(level, class) FILTER (NOT sure) OVER (PARTITION BY source) * class) END AS p,
    greatest(0::DOUBLE, coalesce(max_by(remains, class) FILTER (NOT sure) OVER (PARTITION BY source), 0)) AS remains
  FROM sures
), ranked AS (
  SELECT doc_id, size, s.source, u, source_size, target, whole, p, remains, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
  FROM classed s JOIN plan l ON s.source IS NOT DISTINCT FROM l.source AND s.class = l.class
), run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM ranked
)
SELECT doc_id, size, source_size, target, p,
  ((whole + CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= remains THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""
