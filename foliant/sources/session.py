"""Keyed snapshots: sessions, models and preferences, as appended rows of which the latest of each key counts."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import cache_key

SESSION = "key string, updated_at timestamp, pages array<struct<id:string,data_url:string,width:int,height:int,sharpness:double,ocr_text:string,ocr_lines:array<struct<text:string,bbox:array<double>,confidence:double>>,captured_at:timestamp>>"
PREFERENCE = "key string, value string, updated_at timestamp"
MODEL = "name string, data binary, cached_at timestamp, version string"


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *rest))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def save_session(pages: DataFrame, path: str, key: str = "current", now: Column | None = None) -> None:
    """Appends a snapshot of all stored pages, in their order (position)."""
    fields = [c for c in pages.columns if c != "position"]
    held = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("p")))), lambda x: x["p"])
    stamp = F.current_timestamp() if now is None else now
    pages.agg(held.alias("pages")).select(F.lit(key).alias("key"), stamp.alias("updated_at"), "pages").write.mode("append").parquet(path)


def load_session(spark: SparkSession, path: str, key: str = "current") -> DataFrame:
    """The latest snapshot's row; no rows if nothing, nothing readable, or a cleared session is there.

    The snapshots are read once here, so that a broken file shows now and not in the caller's action.
    """
    try:
        rows = spark.read.schema(SESSION).parquet(path).filter(F.col("key") == key)
        found = latest(rows, ["key"], ["updated_at"]).filter("pages IS NOT NULL")
        found.agg(F.sum(F.xxhash64(*found.columns))).first()
        return found
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], SESSION)


def clear_session(spark: SparkSession, path: str, key: str = "current", now: Column | None = None) -> None:
    """Clears one key, by a newer snapshot without pages; other sessions stay."""
    stamp = F.current_timestamp() if now is None else now
    pages = F.lit(None).cast(spark.createDataFrame([], SESSION).schema["pages"].dataType)
    spark.range(1).select(F.lit(key).alias("key"), stamp.alias("updated_at"), pages.alias("pages")).write.mode("append").parquet(path)


def session_pages(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("key", F.posexplode("pages").alias("p", "page")).select("key", (F.col("p") + 1).cast("int").alias("position"), "page.*")


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(table.unionByName(new), keys, order)


def save_preference(spark: SparkSession, path: str, key: str, value: str, now: Column | None = None) -> None:
    """Appends a setting; of each key the newest counts."""
    stamp = F.current_timestamp() if now is None else now
    spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), stamp.alias("updated_at")).write.mode("append").parquet(path)


def saved_preferences(spark: SparkSession, path: str) -> DataFrame:
    """key, value: the newest of each key."""
    return latest(spark.read.schema(PREFERENCE).parquet(path), ["key"], ["updated_at"]).select("key", "value")


def clear_models(spark: SparkSession, path: str) -> None:
    """Empties a model cache."""
    spark.createDataFrame([], MODEL).write.mode("overwrite").parquet(path)


def correlated(requests: DataFrame, results: DataFrame, id_col: str = "id") -> DataFrame:
    """Every request with its result by id; ``answered`` tells whether there is one."""
    return requests.join(results.withColumn("answered", F.lit(True)), id_col, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def cached_models(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """wanted(language, model) with the cached data where name and version agree; hit tells which."""
    key = wanted.withColumn("name", cache_key(F.col("language"), F.col("model")))
    good = latest(cache, ["name"], ["cached_at"]).filter(F.col("version") == version).select("name", "data", "cached_at")
    return key.join(good, "name", "left").withColumn("hit", F.col("data").isNotNull())


def fetched(responses: DataFrame) -> DataFrame:
    """Downloads that are no HTML page; expected_length is 0 where the header is missing or no number."""
    from foliant.functions.text import content_length, is_html

    return responses.filter(~F.coalesce(is_html(F.col("content_type")), F.lit(False))).withColumn("expected_length", content_length(F.col("content_length")))


def results_between(results: DataFrame, start: Column, end: Column) -> DataFrame:
    """Range scan by creation time; the comparison reaches the Parquet scan."""
    return results.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
