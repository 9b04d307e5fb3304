"""A layout by range with a zone map: rows of like keys share files, and a range scan opens only files that can hold its rows.

``write_zoned`` deals rows out by ranges of the key (a range with many rows, or one key that many rows share, is cut into several files by
``rows_a_file``), sorts inside files, and writes beside them what each file holds: least and greatest key, rows, nulls. A second write adds
files and a map part of its own. ``read_zoned`` looks the range up in the map and hands Spark those files alone; inside them the
filter reaches the Parquet row groups. The map has a row for each file, and only the names of files that are hit reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES, DATA = "zones", "data"


def write_zoned(rows: DataFrame, path: str, key: str, files: int | None = None, rows_a_file: int = 5_000_000) -> None:
    """Appends the rows to the layout at ``path``. ``files``: ranges, else the session's shuffle partitions."""
    spark = rows.sparkSession
    part = f"{path}/{DATA}/{uuid.uuid4().hex}"
    # the hash keeps one hot key from being one range
    ranged = [F.col(key).asc_nulls_first(), F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(files, *ranged) if files else rows.repartitionByRange(*ranged)
    dealt.sortWithinPartitions(F.col(key).asc_nulls_first()).write.option("maxRecordsPerFile", rows_a_file).parquet(part)
    held = spark.read.schema(rows.schema).parquet(part).groupBy(F.col("_metadata.file_path").alias("file"))
    bounds = held.agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"))
    bounds.coalesce(1).write.mode("append").parquet(f"{path}/{ZONES}")  # a row for each file


def zones(spark: SparkSession, path: str) -> DataFrame:
    """file, least, greatest, rows, nulls."""
    return spark.read.parquet(f"{path}/{ZONES}")


def read_zoned(spark: SparkSession, path: str, key: str, start: Column, end: Column) -> DataFrame:
    """The rows with start <= key < end. Rows without a key are in no range."""
    hit = [r["file"] for r in zones(spark, path).filter((F.col("greatest") >= start) & (F.col("least") < end)).select("file").collect()]
    whole = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{DATA}")
    if not hit:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*hit).filter((F.col(key) >= start) & (F.col(key) < end))
