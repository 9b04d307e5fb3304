"""Exact dedup through an extendible-hash index kept on shared files (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z; a null text counts as empty.

1. *Entries.* A batch's rows are grouped by (64-bit key, normalised text): copies combine before the shuffle, so a group of copies costs
   one row per task however large it is, and the group-by compares whole texts byte by byte. An entry holds key, SHA-256 and length of
   its text; texts of one key that differ are chained as entries of that key.
2. *Directory.* A bucket is a prefix of the key, a slot of the directory points to one. It starts with one slot. When an insert leaves a
   bucket over its capacity, the bucket splits on its next bit, again until no part is over it, and the directory doubles when the bucket
   was at full depth. It never has more than 2**MAX_DEPTH slots (the capacity rises with the number of entries instead), so it
   may be broadcast.
3. *Files.* A bucket's entries are one folder of the shared files. An insert reads the files of the buckets that it touches, puts old
   and new entries together by (key, SHA-256, length), and the owner tasks of those buckets, split or not, write them anew, sorted by key.
   Other buckets' files stay as they are.
4. *Lookup.* Every row is sent to its bucket by the directory and finds its entry in the bucket's file by (key, SHA-256). Entries with over a
   1,000th of all rows (so less than 1,000 of them) are broadcast first, so that no task gets the rows of a hot text.

Defined results: rows with a null id take part, but never stay unless the whole group has null
ids; rows repeated with the id of the row that stays are all marked kept; an empty table gives no
rows; columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, discard, shared_path, staged, table, text_of

MAX_DEPTH = 16
CAPACITY = 1 << 12
HOT_SHARE = 1000
ENTRY = ("key", "sha", "n_bytes", "keep_id", "group_size")


def slot_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Bucket:
    """Prefix of ``depth`` bits, and the folder of its entries (none: empty)."""

    prefix: int
    depth: int
    folder: str | None = None


@dataclass
class Index:
    spark: SparkSession
    capacity: int = CAPACITY
    buckets: list[Bucket] = field(default_factory=lambda: [Bucket(0, 0)])
    id_type: str = "long"
    rows: int = 0

    @property
    def depth(self) -> int:
        return max(b.depth for b in self.buckets)

    def directory(self) -> DataFrame:
        """slot, bucket: 2**depth rows."""
        wide = self.depth
        spans = [(b.prefix << (wide - b.depth), ((b.prefix + 1) << (wide - b.depth)) - 1, i) for i, b in enumerate(self.buckets)]
        spans = self.spark.createDataFrame(spans, "first long, last long, bucket int")
        return F.broadcast(spans.select(F.explode(F.sequence("first", "last")).alias("slot"), "bucket"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows(key, ...) with their bucket."""
        if self.depth == 0:
            return rows.withColumn("bucket", F.lit(0))
        return rows.withColumn("slot", slot_of(F.col("key"), self.depth)).join(self.directory(), "slot").drop("slot")

    def entries(self, of: list[Bucket] | None = None) -> DataFrame:
        """The entries on file, of all buckets or of some."""
        folders = sorted({b.folder for b in (self.buckets if of is None else of) if b.folder})
        schema = f"key long, sha string, n_bytes long, keep_id {self.id_type}, group_size long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(text_of(text_col))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The entries of a batch."""
    per = fingerprints(docs, id_col, text_col).groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return per.select("key", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size")


def split(bucket: Bucket, counts: dict[int, int], capacity: int) -> list[Bucket]:
    """The bucket, or its parts after splits. counts: entries by the key's first MAX_DEPTH bits, of this bucket alone."""
    if sum(counts.values()) <= capacity or bucket.depth == MAX_DEPTH:
        return [bucket]
    at = MAX_DEPTH - bucket.depth - 1
    parts = []
    for bit in (0, 1):
        mine = {s: n for s, n in counts.items() if s >> at & 1 == bit}
        parts += split(Bucket(bucket.prefix * 2 + bit, bucket.depth + 1, None), mine, capacity)
    return parts


def insert(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with one more batch. Only counts by prefix reach the driver, at most 2**MAX_DEPTH of them."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    index = Index(spark, index.capacity, list(index.buckets), kind if not index.rows else index.id_type, index.rows)
    new = staged(grouped(docs, id_col, text_col), "dedup-batch")
    touched = sorted(r["bucket"] for r in index.placed(new).select("bucket").distinct().collect())
    old = index.entries([index.buckets[i] for i in touched])
    if any(index.buckets[i].folder for i in touched):
        together = new.unionByName(old).groupBy("key", "sha", "n_bytes").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        merged = staged(together, "dedup-merged")
        discard(new)
    else:
        merged = new
    fine: dict[int, dict[int, int]] = {i: {} for i in touched}
    for r in index.placed(merged).groupBy("bucket", slot_of(F.col("key"), MAX_DEPTH).alias("fine")).agg(F.count(F.lit(1)).alias("n")).collect():
        fine[r["bucket"]][r["fine"]] = r["n"]
    held = sum(sum(c.values()) for c in fine.values())
    capacity = max(index.capacity, (held >> (MAX_DEPTH - 2)) + 1)
    stay = [b for i, b in enumerate(index.buckets) if i not in fine]
    parts = [p for i in touched for p in split(index.buckets[i], fine[i], capacity)]
    root = shared_path(spark, "dedup-index")
    parts = [Bucket(b.prefix, b.depth, f"{root}/bucket={len(stay) + k}") for k, b in enumerate(parts)]
    index.buckets = stay + parts
    owned = index.placed(merged).repartition(max(1, min(len(parts), 4096)), "bucket").sortWithinPartitions("bucket", "key", "sha")
    owned.select(*ENTRY, "bucket").write.partitionBy("bucket").parquet(root)
    full = {r["bucket"] for r in index.placed(merged).select("bucket").distinct().collect()}
    index.buckets = [Bucket(b.prefix, b.depth, b.folder if i < len(stay) or i in full else None) for i, b in enumerate(index.buckets)]
    index.rows += merged.agg(F.sum("group_size")).first()[0] or 0
    index.rows -= old.agg(F.sum("group_size")).first()[0] or 0
    discard(merged)
    return index


def lookup(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256; without an entry, keep_id is null and group_size 0."""
    rows = fingerprints(docs, id_col, text_col).select("id", "key", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    entries = index.entries()
    hot = entries.filter(F.col("group_size") * HOT_SHARE > index.rows).select("key", "sha", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rows = index.placed(rows).join(F.broadcast(hot), ["key", "sha"], "left")
    # rows of hot texts have their answer: they go anywhere, whatever their id, and match nothing
    found = F.col("hot_size").isNotNull()
    rows = rows.withColumns({"to": F.when(found, F.xxhash64("row")).otherwise(F.col("key")), "of": F.when(~found, F.col("sha"))})
    cold = index.placed(entries).select("bucket", F.col("key").alias("to"), F.col("sha").alias("of"), "keep_id", "group_size")
    return rows.join(cold, ["bucket", "to", "of"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("hot_id", "keep_id").alias("keep_id"),
        F.coalesce("hot_size", "group_size", F.lit(0)).alias("group_size"),
        F.col("id").eqNullSafe(F.coalesce("hot_id", "keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    index = insert(Index(docs.sparkSession, capacity), docs, id_col, text_col)
    return lookup(index, docs, id_col, text_col)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
