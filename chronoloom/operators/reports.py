"""Reports over memories, storage, cost and timing, one row or one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.evaluation import zero_safe


def episodic(triples: DataFrame, chunks: DataFrame, chunk: str) -> DataFrame:
    """chunks, total and unique triples (trimmed, lower case), share of duplicates, empty chunks, mean a chunk, distinct entities.  triples: chunk, s, p, o."""
    f = triples.select(chunk, *(F.lower(F.trim(c)).alias(c) for c in "spo"))
    per = chunks.select(chunk).distinct().join(f.groupBy(chunk).count(), chunk, "left").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count_if(F.col("count").isNull()).alias("empty"))
    unique = f.agg(F.countDistinct(F.struct(*"spo")).alias("unique"))
    names = f.select(F.explode(F.array("s", "o")).alias("e")).where("e <> ''").agg(F.countDistinct("e").alias("entities"))
    j = per.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(names))  # single rows
    return j.select("chunks", "total", "unique", (100.0 * (1 - F.col("unique") / F.greatest("total", F.lit(1)))).alias("duplicate_pct"), "empty", zero_safe(F.col("total"), F.col("chunks")).alias("mean"), "entities")


def semantic(triples: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """nodes, non-empty nodes, triples and their mean a node."""
    j = nodes.select(node).distinct().join(triples.groupBy(node).count(), node, "left")
    return j.agg(F.count("*").alias("nodes"), F.count("count").alias("non_empty"), F.coalesce(F.sum("count"), F.lit(0)).alias("total")).withColumn("mean", zero_safe(F.col("total"), F.col("nodes")))


def storage(items: DataFrame, by: str, interval: Column, nested: Column) -> DataFrame:
    """by, bytes of both forms and how many times smaller the interval form is."""
    g = items.groupBy(by).agg(F.sum(interval).alias("interval_bytes"), F.sum(nested).alias("nested_bytes"))
    return g.withColumn("reduction", zero_safe(F.col("nested_bytes"), F.col("interval_bytes")))


def vector_bytes(n: Column, dim: Column, measured: Column, vectors: Column, width: int = 4) -> tuple[Column, Column]:
    """Raw bytes of n vectors, and an estimate by the overhead of a measured store of so many vectors (raw where none)."""
    raw = (n * dim * width).cast("bigint")
    over = measured / (vectors * dim * width)
    return raw, F.when((vectors > 0) & measured.isNotNull(), F.floor(raw * over).cast("bigint")).otherwise(raw)


def cost_hours(chunks: Column, seconds: float, chars: Column, base: float) -> Column:
    """Hours of chunks at so many seconds each, longer in proportion where texts pass the base length."""
    return chunks * seconds * F.greatest(F.lit(1.0), chars / base) / 3600


def timing(df: DataFrame, by: str, x: str, empty: Column) -> DataFrame:
    """by, n, mean, p50, p95 (nearest rank, half to even), least, most, and how often empty holds; from counts of values, so no group meets in one list."""
    v = df.groupBy(by, x).agg(F.count("*").alias("_n"), F.count_if(empty).alias("_e"))
    g = v.groupBy(by).agg(F.sum("_n").alias("n"), (F.sum(F.col(x) * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum("_e").alias("silent_empty"))
    upto = v.withColumn("_u", F.sum("_n").over(Window.partitionBy(by).orderBy(x))).join(g.select(by, "n"), by)
    at = lambda q: F.min(F.when(F.col("_u") > F.bround(q * (F.col("n") - 1)), F.col(x)))
    return g.join(upto.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95")), by)


def cut_origins(cuts: DataFrame, by: str, origin: str) -> DataFrame:
    """by, cuts, detected, capped, gaps, and the share that was detected."""
    g = cuts.groupBy(by).agg(F.count("*").alias("cuts"), *(F.count_if(F.col(origin) == o).alias(n) for o, n in (("detected", "detected"), ("cap", "capped"), ("gap", "gaps"))))
    return g.withColumn("detected_pct", 100.0 * F.col("detected") / F.col("cuts"))
