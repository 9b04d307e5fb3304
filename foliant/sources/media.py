"""Frames, media files, character sets and preferences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media file endings.
VIDEO = ("mp4", "mov", "webm", "avi")
FRAME = "session_id string, frame_idx long, ts double, ready_state int, width int, height int, channels int, pixels binary"


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths, times, lengths and content of video files; other files are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(VIDEO) + "}").option("recursiveFileLookup", "true").load(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME).parquet(path)


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def duration(frame_count: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame_count / fps).otherwise(F.lit(0.0))


def charset(spark: SparkSession, path: str) -> str:
    """The characters of a charset YAML (``charset_train: "..."``), read through Spark once, on the driver: its size is the alphabet's."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    m = re.search(r'^\s*charset_train\s*:\s*"((?:[^"\\]|\\.)*)"|^\s*charset_train\s*:\s*\'((?:[^\']|\'\')*)\'', text, re.M)
    if not m:
        raise ValueError(f"no charset_train in {path}")
    return re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2].replace("''", "'")


def preferences(stored: DataFrame) -> DataFrame:
    """key, value rows as one row of settings; what is missing or unreadable takes its default."""
    from foliant.functions.text import document_language, model_config

    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return stored.agg(of("model-config").alias("m"), of("document-language").alias("d")).select(
        model_config(F.col("m")).alias("math_enabled"), document_language(F.col("d")).alias("document_language")
    )
