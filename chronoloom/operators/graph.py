"""Graphs as edge tables: personalised PageRank, connected components, entity and passage graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.lineage import cut

CUT = 8


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """node, rank.  edges: src, dst, weight, both directions; seeds: node, weight summing to 1.

    Nodes without edges (seeds alone can be such) send their rank to the seeds.  Nothing but the reset
    reaches them, so one number a round says what they send.  Two joins a round, pre-aggregated; lineage is
    cut every CUT rounds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(seeds.select("node")).distinct()
    base = nodes.join(seeds, "node", "left").select("node", F.coalesce("weight", F.lit(0.0)).alias("reset"))
    if rounds > CUT:
        step, base = cut(step), cut(base)
    rank = base.withColumnRenamed("reset", "rank")
    alone = base.join(out.select(F.col("src").alias("node")), "node", "left_anti").agg(F.sum("reset")).first()[0] or 0.0
    sent = alone
    for i in range(rounds):
        if i and i % CUT == 0:
            rank = cut(rank)
        moved = step.join(rank, step["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = base.join(moved, base["node"] == moved["dst"], "left").select("node", ((1 - damping + damping * sent) * F.col("reset") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        sent = (1 - damping + damping * sent) * alone
    return rank


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (src, dst).

    A round takes the smallest label among neighbours, then that label's own label, so chains halve; each
    round's table is checkpointed, and rounds end when no label fell.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("root").alias("low"))
        step = label.join(near, label["node"] == near["src"], "left").select("node", "root", F.least("root", "low").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("root").alias("above"))
        step = cut(step.join(up, "low", "left").select("node", F.col("root").alias("old"), F.least("low", "above").alias("root")))
        label = step.select("node", "root")
        if step.where("root < old").isEmpty():
            return label


def weighted_edges(facts: DataFrame, passages: DataFrame, synonyms: DataFrame) -> DataFrame:
    """src, dst, weight of an entity and passage graph, both directions.

    facts (s, o): one for each triple and pair, loops left out; passages (passage, entity): 1 each; synonyms
    (src, dst, score): the score takes the place of the triples' count on the same ordered pair.
    """
    f = facts.where("s <> o")
    f = f.select(F.col("s").alias("src"), F.col("o").alias("dst")).unionByName(f.select(F.col("o").alias("src"), F.col("s").alias("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    named = f.join(synonyms, ["src", "dst"], "full").select("src", "dst", F.coalesce("score", "weight").alias("weight"))
    p = passages.distinct()
    p = p.select(F.col("passage").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight")).unionByName(p.select(F.col("entity").alias("src"), F.col("passage").alias("dst"), F.lit(1.0).alias("weight")))
    return named.unionByName(p)


def graph_counts(facts: DataFrame, passages: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row: entities, passages, triples between entities, passage and synonym edges."""
    names = facts.select(F.col("s").alias("n")).unionByName(facts.select(F.col("o").alias("n"))).where("n <> ''")
    one = [names.agg(F.countDistinct("n").alias("entities")), passages.agg(F.countDistinct("passage").alias("passages"), F.countDistinct("passage", "entity").alias("passage_edges")), facts.where("s <> o").agg(F.count("*").alias("fact_edges")), synonyms.agg(F.count("*").alias("synonym_edges"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # single rows
    return out


def entity_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (node) and edges (src, dst, weight) of triples (s, o): non-empty ends, those without an edge too; loops left out, parallel edges counted; both directions."""
    ends = triples.select(F.explode(F.array("s", "o")).alias("node")).where("node <> ''").distinct()
    e = triples.where("s <> '' and o <> '' and s <> o").groupBy("s", "o").agg(F.count("*").cast("double").alias("_n"))
    both = e.select(F.col("s").alias("src"), F.col("o").alias("dst"), "_n").unionByName(e.select(F.col("o").alias("src"), F.col("s").alias("dst"), "_n"))
    return ends, both.groupBy("src", "dst").agg(F.sum("_n").alias("weight"))


def without_chunks(tables: dict[str, DataFrame], mentions: DataFrame, deleted: DataFrame, chunk: str, name: str) -> dict[str, DataFrame]:
    """The tables (of columns chunk or name) and mentions after the chunks are deleted: names go where no other chunk mentions them."""
    gone, dead = deleted.select(chunk).distinct(), orphans(mentions, deleted, chunk, name)
    out = {}
    for k, t in (tables | {"mentions": mentions}).items():
        t = t.join(gone, chunk, "left_anti") if chunk in t.columns else t
        out[k] = t.join(dead, name, "left_anti") if name in t.columns else t
    return out


def orphans(mentions: DataFrame, deleted: DataFrame, chunk: str, name: str) -> DataFrame:
    """Names that only deleted chunks mention."""
    gone = mentions.join(deleted.select(chunk), chunk, "left_semi").select(name).distinct()
    return gone.join(mentions.join(deleted.select(chunk), chunk, "left_anti"), name, "left_anti")
