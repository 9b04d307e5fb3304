"""Tables written once to the folder that driver and executors share, so that loops cut their lineage and lost executors cost no earlier round."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a folder of our own, in one process only; on a cluster this raises."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/foliant-shared").rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path there; what it holds goes when the driver ends."""
    path = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_foliant_path", None):
            p, fs = hadoop(df.sparkSession, path)
            fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out where it is read from fewer partitions than Spark has cores (one small file); larger inputs stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
