"""Clusters, near duplicates, neighbour edges and graph retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import vectors as V
from chronoloom.operators import consolidate, graph, models, neardup, retrieval, similarity

from .base import Registry, table, triples

QUERIES = Registry()
add = QUERIES.add
LEAST = 0.3
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
PAIRS = f"s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@add(f"""WITH {PAIRS} SELECT src, dst, round(score, 6) AS weight FROM s WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 101""")
def knn_edges(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return similarity.matches(e, e, "vec_id", "embedding", LEAST, 101).select("src", "dst", F.round("score", 6).alias("weight"))


@add(f"""WITH RECURSIVE {PAIRS}, o AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS i FROM embeddings),
near AS (SELECT x.i, coalesce(list(y.i) FILTER (y.i < x.i), []) AS earlier FROM o x LEFT JOIN s ON s.src = x.vec_id AND s.score >= {LEAST} LEFT JOIN o y ON y.vec_id = s.dst GROUP BY x.i),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS heads UNION ALL
SELECT n.i, CASE WHEN list_has_any(g.heads, n.earlier) THEN g.heads ELSE list_append(g.heads, n.i) END FROM g JOIN near n ON n.i = g.i + 1),
h AS (SELECT heads FROM g ORDER BY i DESC LIMIT 1)
SELECT o.vec_id, r.vec_id AS representative FROM near n CROSS JOIN h JOIN o ON o.i = n.i JOIN o r ON r.i = CASE WHEN list_contains(h.heads, n.i) THEN n.i ELSE list_min(list_intersect(h.heads, n.earlier)) END""")
def greedy_fact_clusters(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return consolidate.leaders(e, "vec_id", "embedding", F.struct(-F.col("label"), F.col("vec_id")), LEAST)


@add(None)
def sleep_cycle_store(spark, d):
    def embed(x):
        return models.embed_distinct(x, "text", models.hashed_words)

    store, _ = consolidate.sleep_cycles(triples(spark, d), embed)
    return store.drop("variants")


@add(None)
def near_duplicate_clusters(spark, d):
    return neardup.clusters(table(spark, d, "documents"), "doc_id", "text")


MENTIONED = "m AS (SELECT CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS name, l_orderkey FROM lineitem)"


@add(f"""WITH {MENTIONED}, gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT DISTINCT name FROM m WHERE l_orderkey IN (SELECT o_orderkey FROM gone) AND name NOT IN (SELECT name FROM m WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone))""")
def deleted_only_names(spark, d):
    m = table(spark, d, "lineitem").select(F.concat_ws("/", "l_suppkey", "l_partkey").alias("name"), "l_orderkey")
    gone = table(spark, d, "orders").where("o_orderstatus in ('F', 'P')").select(F.col("o_orderkey").alias("l_orderkey"))
    return graph.orphans(m, gone, "l_orderkey", "name")


FACT = """c AS (SELECT 'n' || c_nationkey AS s, lower(c_mktsegment) AS o, c_acctbal AS score, c_custkey AS chunk FROM customer)"""


@add(f"""WITH {FACT}, top AS (SELECT * FROM c ORDER BY score DESC, chunk LIMIT 50), e AS (SELECT s AS entity, score FROM top UNION ALL SELECT o, score FROM top),
m AS (SELECT s AS entity, chunk FROM c UNION ALL SELECT o, chunk FROM c), n AS (SELECT entity, count(DISTINCT chunk) AS chunks FROM m GROUP BY entity)
SELECT entity, round(avg(score / chunks), 4) AS weight FROM e JOIN n USING (entity) GROUP BY entity ORDER BY avg(score / chunks) DESC, entity LIMIT 10""")
def seed_weights(spark, d):
    c = _facts(spark, d)
    m = c.select(F.col("s").alias("entity"), "chunk").unionByName(c.select(F.col("o").alias("entity"), "chunk"))
    return retrieval.seed_weights(retrieval.best(c, "score", "chunk", 50), m, 10).select("entity", F.round("weight", 4).alias("weight"))


def _facts(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("s"), F.lower("c_mktsegment").alias("o"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("chunk"))


@add(f"""WITH {FACT}, f AS (SELECT s AS src, o AS dst FROM c UNION ALL SELECT o, s FROM c), w AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM f GROUP BY 1, 2),
y AS (SELECT 'n0' AS src, 'furniture' AS dst, 0.9 AS score), p AS (SELECT DISTINCT 'c' || chunk AS src, s AS dst FROM c)
SELECT coalesce(w.src, y.src) AS src, coalesce(w.dst, y.dst) AS dst, CAST(coalesce(y.score, w.weight) AS DOUBLE) AS weight FROM w FULL JOIN y ON w.src = y.src AND w.dst = y.dst
UNION ALL SELECT src, dst, 1.0 FROM p UNION ALL SELECT dst, src, 1.0 FROM p""")
def passage_graph_edges(spark, d):
    return _graph(spark, d)


def _graph(spark, d):
    c = _facts(spark, d)
    return graph.weighted_edges(c, c.select(F.concat(F.lit("c"), F.col("chunk")).alias("passage"), F.col("s").alias("entity")), spark.createDataFrame([("n0", "furniture", 0.9)], "src string, dst string, score double"))


def _seeds(spark, d):
    """Weighted entities and scored passages that the search starts from."""
    c = _facts(spark, d)
    m = c.select(F.col("s").alias("entity"), "chunk").unionByName(c.select(F.col("o").alias("entity"), "chunk"))
    passages = retrieval.scaled(c.select(F.concat(F.lit("c"), F.col("chunk")).alias("passage"), "score"), "score")
    seeds = retrieval.seed_weights(retrieval.scaled(retrieval.best(c, "score", "chunk", 5), "score"), m, 5)
    return seeds, passages


@add(None)
def graph_retrieval(spark, d):
    return retrieval.graph_rank(_graph(spark, d), *_seeds(spark, d)).select("passage", F.round("rank", 6).alias("rank"))


@add("""WITH g AS (SELECT vec_id, label, embedding[1] AS s FROM embeddings) SELECT vec_id, label FROM g
QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= CASE label WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 4 END""")
def granularity_candidates(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("s"))
    return retrieval.per_group(e, "label", {0: 5, 1: 3, 2: 2, 3: 1}, "s", "vec_id", 4).select("vec_id", "label")


@add("""WITH x AS (SELECT vec_id, embedding[1] AS s, CASE WHEN label = 3 THEN vec_id END AS chosen FROM embeddings)
SELECT vec_id FROM x ORDER BY chosen IS NULL, chosen, s DESC, vec_id LIMIT 120""")
def filter_then_fill(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("s"), "label")
    return retrieval.fill(e, F.when(F.col("label") == 3, F.col("vec_id")), "s", "vec_id", 120).select("vec_id")


@add("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings, q)
SELECT vec_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS score FROM x""")
def dense_passage_rank(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one query vector
    s = e.crossJoin(q).select("vec_id", V.dot(F.col("embedding"), F.col("q")).alias("score"))
    return retrieval.scaled(s, "score").select("vec_id", F.round("score", 6).alias("score"))
