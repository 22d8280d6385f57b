"""Vector and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import graph, similarity

from .base import Registry, table

QUERIES = Registry()
add = QUERIES.add
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
#: Every row whose id is divisible by this is a query of the searches.
STEP, TOP = 20, 10


def nearest(spark, d, top: int):
    """query_id, rank, vec_id, score, rel (equal labels) of the stated queries' best rows, pruned block by block; and golds of each query."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    m = similarity.matches(e.where(F.col("vec_id") % STEP == 0), e, "vec_id", "embedding", top=top)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    q = e.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    m = m.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"), "score").withColumn("rank", F.row_number().over(w))
    m = m.join(e.select("vec_id", "label"), "vec_id").join(q, "query_id").select("query_id", "rank", "vec_id", "score", (F.col("label") == F.col("l")).alias("rel"))
    golds = q.join(e.groupBy(F.col("label").alias("l")).agg((F.count("*") - 1).alias("golds")), "l").select("query_id", "golds")
    return m, golds


@add(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank, vec_id, round(c, 6) AS score FROM s QUALIFY rank <= 10""")
def cosine_top_k(spark, d):
    return nearest(spark, d, TOP)[0].select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@add(f"SELECT a.vec_id AS src, b.vec_id AS dst, round({COS}, 6) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COS} >= 0.4")
def similarity_edges(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.matches(e, e, "vec_id", "embedding", least=0.4).select("src", "dst", F.round("score", 6).alias("weight"))


@add("SELECT label, pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS pos FROM embeddings) GROUP BY label, pos")
def mean_pooled_vectors(spark, d):
    p = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return p.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@add(f"""WITH s AS (SELECT a.vec_id AS query_id, a.label = b.label AS rel, {COS} AS c, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM s)
SELECT query_id, round(count(*) FILTER (rel AND k <= 10) / 10.0, 6) AS precision_10, round(coalesce(count(*) FILTER (rel AND k <= 10) / nullif(count(*) FILTER (rel), 0), 1), 4) AS recall_10,
round(coalesce(1.0 / min(k) FILTER (rel AND k <= 10), 0), 6) AS mrr_10, round(coalesce(sum(1 / log2(k + 1)) FILTER (rel AND k <= 10), 0), 6) AS dcg_10 FROM r GROUP BY query_id""")
def ranking_metrics(spark, d):
    r, golds = nearest(spark, d, TOP)
    g = r.groupBy("query_id").agg(F.count_if("rel").alias("n"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1))).alias("dcg")).join(golds, "query_id")
    return g.select(
        "query_id", F.round(F.col("n") / 10.0, 6).alias("precision_10"), F.round(F.when(F.col("golds") == 0, 1.0).otherwise(F.col("n") / F.col("golds")), 4).alias("recall_10"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr_10"), F.round(F.coalesce("dcg", F.lit(0.0)), 6).alias("dcg_10"),
    )


#: Rounds by damping: what is left unsettled is below what is rounded off.
ROUNDS = {0.85: 100, 0.5: 40}


def _edges(spark, d):
    """Nations and market segments, weighted by customers; both directions."""
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.col("c_mktsegment").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return c.unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _iterated(damping: float) -> str:
    """A seed stands alone, without edges: what it sends goes to the seeds again."""
    return f"""WITH RECURSIVE c AS (SELECT 'n' || c_nationkey AS src, c_mktsegment AS dst, CAST(count(*) AS DOUBLE) AS weight FROM customer GROUP BY 1, 2), u AS (SELECT * FROM c UNION ALL SELECT dst, src, weight FROM c),
e AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM u),
base AS MATERIALIZED (SELECT node, CAST(CASE WHEN node IN ('n0', 'n1') THEN 0.4 WHEN node = 'alone' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS reset FROM (SELECT DISTINCT src AS node FROM u UNION ALL SELECT 'alone')),
moves AS MATERIALIZED (SELECT src, dst, {damping} * share AS x FROM e UNION ALL SELECT 'alone', node, {damping} * reset FROM base WHERE reset > 0),
r(i, node, rank) AS (
  SELECT 0, node, reset FROM base
  UNION ALL
  SELECT r.i + 1, b.node, {1 - damping} * any_value(b.reset) + coalesce(sum(r.rank * m.x), 0) FROM r CROSS JOIN base b LEFT JOIN moves m ON m.src = r.node AND m.dst = b.node WHERE r.i < {ROUNDS[damping]} GROUP BY r.i, b.node
)
SELECT node, round(rank, 6) AS rank FROM r WHERE i = {ROUNDS[damping]}"""


def _rank(spark, d, damping: float):
    seeds = spark.createDataFrame([("n0", 0.4), ("n1", 0.4), ("alone", 0.2)], "node string, weight double")
    return graph.pagerank(_edges(spark, d), seeds, damping, ROUNDS[damping]).select("node", F.round("rank", 6).alias("rank"))


@add(_iterated(0.85))
def entity_pagerank(spark, d):
    return _rank(spark, d, 0.85)


@add(_iterated(0.5))
def weighted_passage_pagerank(spark, d):
    return _rank(spark, d, 0.5)


@add("SELECT 'n' || c_nationkey AS entity, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS chunks, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS chunk_ids FROM customer GROUP BY 1")
def entity_chunk_index(spark, d):
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("entity")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("x"))
    return c.select("entity", F.size("x").cast("bigint").alias("chunks"), F.array_join("x", ",").alias("chunk_ids"))
