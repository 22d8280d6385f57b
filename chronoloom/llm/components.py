"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (u, v bigint, u > v).

    Each round hangs neighbours below the smallest node known to them; rows are pre-aggregated before
    they move, hot nodes meet only in joins, which the engine can split, and each round's table goes to
    the shared folder.  Ends when every node hangs directly below its root.
    """
    sign = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = materialize(edges.distinct(), name)
    was = sign(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: the larger neighbours of u go to u's smallest neighbour (or u itself)
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u > v").distinct()
        after = materialize(small, name)
        discard(e)
        e, now = after, sign(after)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
