"""Line-wise JSON records and keyed stores: tolerant scans, last write wins, only what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that do not parse are left out."""
    lines = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return lines.where("ok and r is not null").select("r.*")


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row latest in order; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def insert_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with the new rows whose key it lacks."""
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti"))
