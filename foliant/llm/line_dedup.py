"""Cross-site line dedup by distinct-site spread (DataFrame functions only).

A line is what stands between newlines; blank lines are never touched. Lines are equal when equal
after removing spaces and U+0009..U+000D at both ends. A line that occurs on ``min_sites`` distinct sites or more is boilerplate:
its first occurrence (smallest id, then first place in the text) stays, all others are removed.
Keeping the first means that no content leaves the corpus, even where whole documents were copied
to many sites.

1. Each line's 128-bit key gets a HyperLogLog sketch of its sites, built map-side and merged by
   aggregation, so a line with a third of all rows costs one sketch per task.
2. Estimates decide where they are far from the threshold. Between ``1 - BAND`` and ``1 + BAND`` times the threshold the
   line's exact number of distinct sites is counted, for those lines only.
3. The boilerplate keys are joined to (document, line) pairs without texts. A boilerplate line stands in very many documents, so each
   key is dealt out over ``SALTS`` tasks. Each document gets the positions to drop, and its text is put together from the others in
   time proportional to its lines.

Defined results: null text stays null and has no lines; a null site counts as no site; null ids
order first and never hold the first occurrence if another document has an id; rows repeated with the same id and text
are treated alike; an empty table gives no rows; columns of any names may be there and stay, but for ``n_lines`` and ``n_removed``,
which give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import staged, table

MIN_SITES = 8
#: Sketches of 2**11 registers have a standard error of 2.3 %; the band is over four of them.
LOG2_REGISTERS = 11
BAND = 0.125
SALTS = 16
TRIM = "^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$"


def lines_of(text: Column) -> Column:
    """Array of the text's lines, trimmed."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def line_keys(text: Column) -> Column:
    """Array of struct(pos, a, b): the non-blank lines' positions and two independent 64-bit hashes."""
    keyed = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (x != "").alias("full")))
    return F.filter(keyed, lambda k: k["full"])


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """a, b, first_id of the lines on min_sites distinct sites or more. lines: id, site, a, b."""
    spread = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS))).alias("sites"),
        F.min("id").alias("first_id"),
    )
    spread = staged(spread.filter(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + BAND))
    exact = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi")
        .groupBy("a", "b", "site").agg(F.count(F.lit(1)).alias("_"))
        .groupBy("a", "b").agg(F.count("site").alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
    )
    sure = spread.filter(F.col("sites") > min_sites * (1 + BAND)).select("a", "b", "first_id")
    return sure.unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first_id"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with its columns, text_col cleaned, and two more: n_lines and n_removed (non-blank lines)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.xxhash64(text_col).alias("th"), F.explode(line_keys(F.col(text_col))).alias("k")
    ).select("id", "site", "th", "k.pos", "k.a", "k.b")
    lines = staged(keyed, "lines")
    flagged = boilerplate(lines, min_sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.select("id", "th", "pos", "a", "b", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int").alias("salt"))
    # one row for each (document, line), whatever the number of repeats inside the document
    held = salted.join(flagged, ["a", "b", "salt"]).groupBy("a", "b", "id", "th").agg(F.collect_set("pos").alias("at"), F.first("first_id").alias("first_id"))
    at = F.array_sort("at")
    mine = F.col("id").eqNullSafe(F.col("first_id"))
    hit = held.select("id", "th", F.when(mine, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(at).alias("gone"))
    gone = hit.filter(F.size("gone") > 0).groupBy("id", "th").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    # the caller's columns travel as one struct, so no name can clash; lines are cut before the join and so only once
    cut = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id_col).alias("key_id"), F.xxhash64(text_col).alias("key_th"),
        F.split(text_col, "\n", -1).alias("parts"), F.coalesce(F.size(F.filter(lines_of(F.col(text_col)), lambda x: x != "")), F.lit(0)).cast("long").alias("n_lines"),
    )
    joined = cut.join(gone, F.col("key_id").eqNullSafe(F.col("id")) & (F.col("key_th") == F.col("th")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    cleaned = F.array_join(F.transform(stays, lambda i: F.get("parts", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(cleaned)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of the cleaned text (null for a null text)."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), spread AS (
  SELECT t, min(doc_id) AS first_id FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.*, s.t IS NOT NULL AND NOT (l.doc_id = s.first_id AND row_number() OVER (PARTITION BY l.doc_id, l.t ORDER BY i) = 1) AS gone
  FROM lines l LEFT JOIN spread s ON l.t = s.t
), built AS (
  SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(b.text, '')) END AS text_sha256
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
"""
