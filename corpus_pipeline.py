"""A training corpus out of ``documents``, in five stages; each works on all that its predecessor kept.

1. language ID: texts without letters, or too far from every profile, go; ``lang`` becomes the prediction.
2. line dedup: cross-site boilerplate lines go but for their first occurrence; a document that loses
   all its lines goes.
3. MinHash near-dedup: five-word shingles, similarity 0.8 or more; of each group one document stays.
4. mixing: each source's documents are taken 0 to 3 times to meet its target; a document taken twice
   comes twice.
5. BPE: ids and their decoded text, as digests.

Stages but the last return the columns of ``documents``. Between stages a Parquet table in the
shared folder cuts the lineage.

Defined results of the stages: a null text goes with the first; columns of other names are left behind; repeated rows are one document
for near-dedup and several for the others; rows without an id are documents like others; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, language_id, line_dedup, minhash, mixing
from foliant.llm.common import discard, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Clean documents score 0.45 and more; this leaves room for short ones.
MIN_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs, F.lit(True))
    known = language_id.identify(docs.select(*COLUMNS), profiles)
    kept = known.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in COLUMNS])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    left = cleaned.filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*[chars.alias(c) if c == "n_chars" else c for c in COLUMNS])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are numbered, so rows of one id with different texts, and rows without an id, take part on their own. Of each group the row
    with the smallest id stays (null last), then the first by number."""
    numbered = staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    groups = minhash.near_duplicates(numbered.select("_row", "text"), id_col="_row").select("_row", "component_id")
    named = numbered.select("_row", "doc_id").join(groups, "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return numbered.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.select(F.col("doc_id").alias("_doc"), *COLUMNS[1:])
    taken = mixing.mix(named, id_col="_doc", keep=COLUMNS[1:]).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.withColumnRenamed("_doc", "doc_id").withColumn("_copy", times).select(*COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near_copies),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", encode_and_decode),
]

#: Components of near-copies and merges of tokens are not said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return after
        after = staged(after, f"stage-{k}")
        if k:
            discard(docs)
        docs = after
    return docs
