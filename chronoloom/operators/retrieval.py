"""Time-gated retrieval: dense and graph ranking, seeds, fills and candidates by granularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import vectors as V
from chronoloom.operators import graph


def scaled(df: DataFrame, score: str) -> DataFrame:
    """score scaled to 0..1 over the table, 1 where it is constant; the bounds are one row."""
    b = F.broadcast(df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))
    x = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(b).withColumn(score, x).drop("_lo", "_hi")


def best(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def dense_rank(passages: DataFrame, vec: str, query: list[float], unit: bool = False) -> DataFrame:
    """passages with score: dot product (cosine if unit) with the query, scaled to 0..1."""
    q = F.lit(query).cast("array<double>")
    return scaled(passages.withColumn("score", V.cosine(F.col(vec), q) if unit else V.dot(F.col(vec), q)), "score")


def seed_weights(facts: DataFrame, mentions: DataFrame, top: int) -> DataFrame:
    """entity, weight: mean over its top facts (s, o, score) of score / chunks that mention it; the top entities only.

    mentions: entity, chunk.
    """
    ends = facts.select(F.explode(F.array(F.lower("s"), F.lower("o"))).alias("entity"), "score")
    chunks = mentions.join(ends.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.countDistinct("chunk").alias("chunks"))
    w = ends.join(chunks, "entity", "left").groupBy("entity").agg(F.avg(F.col("score") / F.coalesce("chunks", F.lit(1))).alias("weight"))
    return best(w, "weight", "entity", top)


def graph_rank(edges: DataFrame, entities: DataFrame, passages: DataFrame, passage_weight: float = 0.05, damping: float = 0.5, rounds: int = 40) -> DataFrame:
    """passage, rank by personalised PageRank seeded by entities (entity, weight) and passages (passage, score in 0..1).

    Negative and missing weights count as none, and seeds outside the graph fall away.
    """
    s = entities.select(F.col("entity").alias("node"), "weight").unionByName(passages.select(F.col("passage").alias("node"), (F.col("score") * passage_weight).alias("weight")))
    s = s.where("weight > 0 and not isnan(weight)").groupBy("node").agg(F.sum("weight").alias("weight"))
    s = s.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    s = s.crossJoin(F.broadcast(s.agg(F.sum("weight").alias("_all")))).select("node", (F.col("weight") / F.col("_all")).alias("weight"))
    r = graph.pagerank(edges, s, damping, rounds)
    return r.join(passages.select(F.col("passage").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "passage")


def retrieve(edges: DataFrame, facts: DataFrame, mentions: DataFrame, passages: DataFrame, facts_kept: int = 5, k: int = 5) -> DataFrame:
    """passage, rank: k best by the graph if any fact survives (facts: s, o, score, already filtered), else by dense score."""
    top = scaled(facts, "score").orderBy(F.desc("score"), "s", "o").limit(facts_kept)
    if top.isEmpty():
        return best(passages.select("passage", F.col("score").alias("rank")), "rank", "passage", k)
    return best(graph_rank(edges, seed_weights(top, mentions, facts_kept), passages), "rank", "passage", k)


def triple_scores(triples: DataFrame, ranks: DataFrame) -> DataFrame:
    """triples (s, o, ...) with score: the ranks (node, rank) of both ends, added."""
    a, b = ranks.select(F.col("node").alias("s"), F.col("rank").alias("_a")), ranks.select(F.col("node").alias("o"), F.col("rank").alias("_b"))
    return triples.join(a, "s", "left").join(b, "o", "left").withColumn("score", F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).drop("_a", "_b")


def per_group(df: DataFrame, by: str, limits: dict[str, int], score: str, tie: str, default: int = 5) -> DataFrame:
    """The best rows of each group by its own limit, pooled."""
    k = F.coalesce(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col(by)], F.lit(default)) if limits else F.lit(default)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("_k") <= k).drop("_k")


def fill(df: DataFrame, chosen: Column, score: str, tie: str, k: int) -> DataFrame:
    """k rows: chosen ones by their position first (chosen: position or null), then the best of the rest."""
    return df.withColumn("_c", chosen).orderBy(F.col("_c").isNull(), "_c", F.desc(score), tie).limit(k).drop("_c")


def unseen(df: DataFrame, seen: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """k best rows that were not retrieved before; twice k are fetched first, as a bound on what seen can hide."""
    return best(best(df, score, key, 2 * k).join(seen.select(key), key, "left_anti"), score, key, k)


def visible(df: DataFrame, until: Column | int | str, end: str = "end_time") -> DataFrame:
    """Rows that ended at or before until."""
    return df.where(F.col(end) <= until)


def by_time_range(clips: DataFrame, start: int, end: int, a: str = "start_time", b: str = "end_time") -> DataFrame:
    """Clips that touch the closed interval."""
    return clips.where((F.col(a) <= end) & (F.col(b) >= start))


def same_surface(entities: DataFrame, surface: str, score: str, tie: str) -> DataFrame:
    """The entities whose surface form is the best one's, with their number and the margin between the first two."""
    first = F.broadcast(best(entities, score, tie, 1).select(surface))
    c = entities.join(first, surface, "left_semi")
    m = c.agg(F.count("*").alias("candidates")).crossJoin(F.broadcast(c.orderBy(F.desc(score)).limit(2).agg(F.max(score).alias("_a"), F.min(score).alias("_b"))))  # single rows
    return c.crossJoin(F.broadcast(m)).withColumn("margin", F.when(F.col("candidates") > 1, F.col("_a") - F.col("_b"))).drop("_a", "_b")
