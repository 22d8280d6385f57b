"""Evaluation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.operators import evaluation as E

from .base import Registry, table

QUERIES = Registry()
add = QUERIES.add


@add("""SELECT count(*) AS total, count(*) FILTER (toxic = 0) AS answered, count(*) FILTER (toxic = 1) AS abstained, count(*) FILTER (toxic = 0 AND quality = 1) AS correct, count(*) FILTER (toxic = 0 AND quality = 0) AS wrong,
round(coalesce(count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(*) FILTER (toxic = 0), 0), 0), 6) AS accuracy, round(coalesce(count(*) FILTER (toxic = 0 AND quality = 0) / nullif(count(*), 0), 0), 6) AS hallucination_rate FROM labels""")
def eval_summary(spark, d):
    n = table(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.expr("toxic = 0")).alias("answered"), F.count_if(F.expr("toxic = 1")).alias("abstained"), F.count_if(F.expr("toxic = 0 and quality = 1")).alias("correct"), F.count_if(F.expr("toxic = 0 and quality = 0")).alias("wrong"))
    return n.select("*", F.round(E.zero_safe(F.col("correct"), F.col("answered")), 6).alias("accuracy"), F.round(E.zero_safe(F.col("wrong"), F.col("total")), 6).alias("hallucination_rate"))


CELL = "CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'first' WHEN toxic = 1 THEN 'second' ELSE 'neither' END"


@add(f"SELECT lang, {CELL} AS cell, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def paired_arms(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang", F.expr(CELL).alias("cell")).agg(F.count("*").alias("n"))


@add("""WITH g AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(greatest(0, (k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS low, round(least(1, (k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS high FROM g""")
def wilson_by_group(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return g.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@add("""WITH g AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 0 AND toxic = 0) AS c FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))))) END, 9) AS p FROM g""")
def mcnemar_exact(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_if(F.expr("quality = 0 and toxic = 1")).alias("b"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("c"))
    return g.select("lang", "b", "c", F.round(E.mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


@add("""WITH b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark), x AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY 1, 2), y AS (SELECT item_id + 1 AS item_id, w, n FROM x),
o AS (SELECT item_id, sum(least(x.n, y.n)) AS common FROM x JOIN y USING (item_id, w) GROUP BY item_id), s AS (SELECT item_id, sum(n) AS n FROM x GROUP BY 1), t AS (SELECT item_id, sum(n) AS n FROM y GROUP BY 1)
SELECT s.item_id, round(2.0 * coalesce(common, 0) / (s.n + t.n), 6) AS f1 FROM s JOIN t USING (item_id) LEFT JOIN o USING (item_id)""")
def token_f1(spark, d):
    x = table(spark, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    y = x.select((F.col("item_id") + 1).alias("item_id"), "w", F.col("n").alias("m"))
    both = x.join(y, ["item_id", "w"], "full").groupBy("item_id").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))).alias("common"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return both.where("n is not null and m is not null").select("item_id", F.round(2.0 * F.col("common") / (F.col("n") + F.col("m")), 6).alias("f1"))


@add("""SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95_linear,
list_sort(list(n_chars))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)] AS p95_nearest, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang""")
def chunk_length_stats(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("lang", "n_chars")
    g = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", F.lit(0.5)).alias("median"), F.round(F.percentile("n_chars", F.lit(0.95)), 6).alias("p95_linear"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    # nearest rank from counts of values: rows of a language never meet in one list
    v = docs.groupBy("lang", "n_chars").count()
    w = Window.partitionBy("lang").orderBy("n_chars")
    v = v.withColumn("upto", F.sum("count").over(w)).join(F.broadcast(g.select("lang", "n")), "lang").where(F.col("upto") > F.bround(0.95 * (F.col("n") - 1)))
    return g.join(v.groupBy("lang").agg(F.min("n_chars").alias("p95_nearest")), "lang").select("lang", "n", "total", "mean", "median", "p95_linear", "p95_nearest", "least", "most")


@add("""WITH r AS (SELECT min(n_chars) AS lo, (max(n_chars) - min(n_chars)) / 10.0 AS step FROM documents)
SELECT CAST(least(9, floor((n_chars - lo) / step)) AS BIGINT) AS bin, count(*) AS n FROM documents, r GROUP BY 1""")
def length_histogram(spark, d):
    docs = table(spark, d, "documents").select("n_chars")
    r = F.broadcast(docs.agg(F.min("n_chars").alias("lo"), ((F.max("n_chars") - F.min("n_chars")) / 10.0).alias("step")))  # one row
    return docs.crossJoin(r).groupBy(F.least(F.lit(9), F.floor((F.col("n_chars") - F.col("lo")) / F.col("step"))).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@add("""SELECT source, count(*) AS docs, round(avg(n_chars), 4) AS mean_chars, round(avg(len(string_split(text, ' '))), 4) AS mean_words FROM documents GROUP BY source""")
def mean_text_sizes(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg(F.size(F.split("text", " "))), 4).alias("mean_words"))


@add("""SELECT event_type, CAST(sum(value) FILTER (user_id % 2 = 0) AS DOUBLE) IS NOT NULL AS has_even, count(*) FILTER (user_id % 2 = 0) AS even, count(*) FILTER (user_id % 2 = 1) AS odd FROM events GROUP BY event_type""")
def status_counts(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg((F.count_if(F.expr("user_id % 2 = 0")) > 0).alias("has_even"), F.count_if(F.expr("user_id % 2 = 0")).alias("even"), F.count_if(F.expr("user_id % 2 = 1")).alias("odd"))
