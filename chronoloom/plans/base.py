"""Registration of queries beside their SQL, and the tables as the operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry(dict):
    def add(self, sql: str | None = None):
        def put(f):
            self[f.__name__] = (f, sql)
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, node): supplier, return flag and brand of every order line, by ship month."""
    li, su, pa = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "part"))
    return (
        li.select("l_suppkey", "l_partkey", "l_returnflag", "l_shipdate")
        .join(su.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(pa.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_name").alias("s"), F.col("l_returnflag").alias("p"), F.col("p_brand").alias("o"), F.date_format("l_shipdate", "yyyyMM").alias("node"))
    )


TRIPLES = """triples AS (
  SELECT s_name AS s, l_returnflag AS p, p_brand AS o, strftime(l_shipdate, '%Y%m') AS node
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, t, value, event_type): events in seconds since 1970."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_type")


TIMELINE = "timeline AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_type FROM events)"
