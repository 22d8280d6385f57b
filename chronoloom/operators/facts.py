"""Triples to facts with validity intervals: fold, snapshot and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T

VARIANTS = 8


def fold_facts(triples: DataFrame) -> DataFrame:
    """triples (s, p, o, node) to one row a fact: folded parts, first and last node, support and up to VARIANTS surface forms.

    Equal surface forms are counted before anything is folded, so text work and the second shuffle grow with
    the distinct forms.
    """
    once = triples.groupBy("s", "p", "o").agg(F.min("node").alias("first_seen"), F.max("node").alias("last_seen"), F.count("*").alias("support"))
    # behind a generator the normalised texts are computed once a row; filters above it cannot pull them in again
    n = once.select("*", F.explode(F.array(F.struct(*(F.lower(T.normalise_text(F.col(c))).alias(c) for c in "spo")))).alias("_n"))
    k = n.select("*", *(T.one_person(F.col("_n")[c]).alias(f"k{c}") for c in "spo"))
    return combine(k.where(~T.degenerate(F.col("ks"), F.col("kp"), F.col("ko"))).select("ks", "kp", "ko", "first_seen", "last_seen", "support", F.array(F.struct("s", "p", "o")).alias("variants")))


def combine(facts: DataFrame) -> DataFrame:
    """Partial stores (ks, kp, ko, first_seen, last_seen, support, variants) as one."""
    return facts.groupBy("ks", "kp", "ko").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("support").alias("support"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("variants")))), 1, VARIANTS).alias("variants"),
    )


def snapshot(facts: DataFrame, key: str | Column) -> DataFrame:
    """Facts first seen at or before key; facts do not expire."""
    return facts.where(F.col("first_seen") <= key)


def statistics(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count("*").alias("facts"), F.sum("support").alias("support"), F.round(F.avg("support"), 6).alias("mean_support"), F.max("support").alias("max_support"),
        F.count_if(F.col("support") == 1).alias("singletons"), F.countDistinct("ks").alias("subjects"), F.countDistinct("kp").alias("predicates"), F.countDistinct("ko").alias("objects"),
        F.round(F.sum("support") / F.count("*"), 6).alias("compression"),
    )


def cumulative(triples: DataFrame) -> DataFrame:
    """What writing every node's full state would cost: final triples, all triples written, and their ratio.

    The running sum goes over one row for each node.
    """
    n = triples.groupBy("node").count()
    run = n.select(F.sum("count").over(Window.orderBy("node")).alias("state"))
    return run.agg(F.count("*").alias("nodes"), F.max("state").alias("final_triples"), F.sum("state").alias("triples_written_upper_bound")).withColumn("amplification", F.round(F.col("triples_written_upper_bound") / F.col("final_triples"), 6))
