"""Shards, splits and evenly spread samples of an ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import frames
from chronoloom.operators.lineage import cut


def numbered(df: DataFrame, order: str) -> DataFrame:
    """_i: rank from 0 in order, by counts of ranges and ranks inside them, so no task sees all rows."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    parts = parts.withColumn("_p", F.shiftrightunsigned("_m", 33)).withColumn("_m", F.col("_m").bitwiseAND((1 << 33) - 1))
    parts = cut(parts)  # the numbers must not change between the count and the join
    n = parts.groupBy("_p").count()
    before = n.select("_p", F.expr("sum(count) over (order by _p rows unbounded preceding) - count").alias("_before"))  # one row a partition
    return parts.join(F.broadcast(before), "_p").withColumn("_i", F.col("_before") + F.col("_m")).drop("_p", "_m", "_before")


def stride_shard(df: DataFrame, index: Column, shards: int, shard: int) -> DataFrame:
    return df.where(index % shards == shard)


def contiguous(index: Column, total: Column, parts: int) -> Column:
    """Part of row index when total rows go into parts of ceil(total / parts); the last is the short one."""
    return F.floor(index / F.ceil(total / parts)).cast("bigint")


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows int(i * N / n) for i below n: an evenly strided sample in order."""
    x = numbered(df, order)
    total = x.count()
    at = F.broadcast(df.sparkSession.range(min(n, total)).select(F.floor(F.col("id") * F.lit(total) / n).cast("bigint").alias("_i")).distinct())  # n rows
    return x.join(at, "_i", "left_semi").drop("_i")


def stepped_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every max(1, N // n)-th row in order, the first n of them."""
    x = numbered(df, order)
    step = max(1, x.count() // n)
    return x.where((F.col("_i") % step == 0) & (F.col("_i") < step * n)).drop("_i")


def proportional(df: DataFrame, by: str, index: str, most: int) -> DataFrame:
    """At most about `most` rows in all: each group keeps its share, at least one, evenly spread over index 0..n-1."""
    n = df.groupBy(by).agg(F.count("*").alias("_n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_all"))))  # one row
    keep = n.select(by, F.explode(frames.spread(F.col("_n"), frames.share(F.col("_n"), F.col("_all"), most))).alias(index))
    return df.join(keep, [by, index], "left_semi")
