"""Shared ground of the training-data operators: word rule, shared folder, staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.shipping import ship

#: A word is a longest run of characters other than space and U+0009..U+000D.
WORD_GAP = "[ \\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as long; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.size(F.array_remove(parts, "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Only where that setting is missing and Spark runs in one process (tests) a folder of our own is used; on a cluster
    without the setting this raises, since executors would write to disks that others don't see.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/foliant-shared").rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind once they end; else those stay until the driver's memory is tidied."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and a lost
    executor costs no earlier stage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_foliant_path", None)
        if path:
            p, fs = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1024) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers, and with batches of bounded rows and bytes, so that a run of very
    long texts fits a worker."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: run(parts(batches, rows)), schema)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it is read from fewer partitions than Spark has cores (one small file). Larger inputs, and
    what comes out of a shuffle, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices (no copies); a slice has over one row only within ``rows`` and about ``size`` bytes. Empty batches stay out."""
    for batch in batches:
        step = max(1, min(rows, int(size / max(1, batch.nbytes) * batch.num_rows)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
