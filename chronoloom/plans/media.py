"""Windows, samples, frames, replies and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import frames, jsonfix
from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.operators import evaluation, sampling, sequences
from chronoloom.sources import captions

from .base import TIMELINE, Registry, table, timeline

QUERIES = Registry()
add = QUERIES.add


@add(f"""WITH RECURSIVE {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM timeline),
n AS (SELECT user_id, i, t AS w FROM r WHERE i = 1 UNION ALL
SELECT r.user_id, r.i, CASE WHEN r.t < n.w + 604800 THEN n.w ELSE floor(r.t / 604800) * 604800 END FROM n JOIN r ON r.user_id = n.user_id AND r.i = n.i + 1)
SELECT user_id, w AS window_start, count(*) AS events FROM n GROUP BY 1, 2""")
def anchored_windows(spark, d):
    return sequences.anchored_windows(timeline(spark, d), "user_id", "t", 604_800.0).groupBy("user_id", "window_start").agg(F.count("*").alias("events"))


@add("""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(floor(i / ceil(n / 7)) AS BIGINT) AS part FROM x""")
def contiguous_split(spark, d):
    x = sampling.numbered(table(spark, d, "documents").select("doc_id"), "doc_id")
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).select("doc_id", sampling.contiguous(F.col("_i"), F.col("n"), 7).alias("part"))


@add("""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT DISTINCT CAST(floor(j * (SELECT count(*) FROM documents) / 30) AS BIGINT) AS i FROM range(30) t(j))
SELECT doc_id FROM x JOIN s USING (i)""")
def even_sample(spark, d):
    return sampling.even_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 30)


@add("""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, (SELECT count(*) FROM documents) // 20) AS step FROM documents) SELECT doc_id FROM x WHERE i % step = 0 AND i < step * 20""")
def stepped_sample(spark, d):
    return sampling.stepped_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 20)


@add("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn FROM conversations), g AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT conv_id, n, greatest(1, CAST(floor(n * (100.0 / (SELECT count(*) FROM c))) AS BIGINT)) AS k FROM g),
p AS (SELECT DISTINCT conv_id, unnest(list_transform(range(0, least(k, n)), lambda j: CASE WHEN k >= n THEN j ELSE CAST(floor(j * (n - 1) / greatest(k - 1, 1)) AS BIGINT) END)) AS i FROM k)
SELECT c.conv_id, c.turn FROM c JOIN p USING (conv_id, i)""")
def proportional_subsample(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn").withColumn("i", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint"))
    return sampling.proportional(c, "conv_id", "i", 100).select("conv_id", "turn")


@add("""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(range(0, length(text), 30), [0, length(text) - 1]))), ',') AS by_rate,
array_to_string(list_sort(list_distinct(list_concat(list_transform(range(0, 8), lambda i: CAST(floor(i * (length(text) - 1) / 7) AS BIGINT)), [0, length(text) - 1]))), ',') AS by_count FROM benchmark WHERE length(text) > 8""")
def frame_indices(spark, d):
    b = table(spark, d, "benchmark").where(F.length("text") > 8).withColumn("n", F.length("text"))
    return b.select("item_id", F.array_join(frames.by_rate(F.col("n"), F.lit(30.0)), ",").alias("by_rate"), F.array_join(frames.by_count(F.col("n"), F.lit(8)), ",").alias("by_count"))


@add("""SELECT event_id, CAST(strftime(ts, '%d%H%M%S') || '00' AS BIGINT) AS start, CAST(strftime(ts + INTERVAL 15 SECOND, '%d%H%M%S') || '00' AS BIGINT) AS end_ FROM events""")
def time_ranges(spark, d):
    e = table(spark, d, "events")
    end = F.col("ts") + F.expr("interval 15 seconds")
    text = F.concat(F.lit("DAY "), F.date_format("ts", "dd HH:mm:ss"), F.lit(" - day"), F.date_format(end, "dd HH:mm:ss"))
    r = K.time_range(text)
    return e.select("event_id", r["start"].alias("start"), r["end"].alias("end_"))


@add("""SELECT event_id, CASE event_type WHEN 'click' THEN 'clean' WHEN 'view' THEN 'fenced' WHEN 'error' THEN 'sliced' WHEN 'signup' THEN 'repaired' ELSE 'failed' END AS how,
CASE WHEN event_type <> 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def salvaged_replies(spark, d):
    e = table(spark, d, "events")
    reply = (
        F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_type") == "error", F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Done.")))
        .when(F.col("event_type") == "signup", F.concat(F.rtrim(F.replace("props", F.lit("}"), F.lit(""))), F.lit(', "rest": ["cut of'))).otherwise(F.lit("I cannot answer."))
    )
    s = jsonfix.salvaged(reply)
    return e.select("event_id", s.alias("s")).select("event_id", F.col("s.how").alias("how"), F.get_json_object("s.json", "$.k").cast("bigint").alias("k"))


@add("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type || ',error' WHEN event_type = 'error' THEN 'error' ELSE '' END AS chosen FROM events""")
def filter_replies(spark, d):
    ids = F.array(*map(F.lit, ("click", "error", "view")))
    reply = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit('Best: ["'), "event_type", F.lit('", "error", "none"]'))).when(F.col("event_type") == "error", F.lit("the error one")).otherwise(F.lit("[]"))
    return table(spark, d, "events").select("event_id", F.array_join(jsonfix.filter_reply(reply, ids), ",").alias("chosen"))


@add("SELECT event_id, event_type AS relevance, 'k is ' || CAST(json_extract(props, '$.k') AS BIGINT) AS reason FROM events")
def sectioned_replies(spark, d):
    reply = jsonfix.template("[[ ## relevance ## ]]\n{kind}\n\n[[ ## reason ## ]]\nk is {k}\n[[ ## completed ## ]]")
    e = table(spark, d, "events")
    m = jsonfix.sections(reply(kind=F.col("event_type"), k=F.get_json_object("props", "$.k")))
    return e.select("event_id", m["relevance"].alias("relevance"), m["reason"].alias("reason"))


@add(None)
def closest_benchmark(spark, d):
    kinds = F.array(*map(F.lit, ("the quick answer", "no answer at all", "something else")))
    return table(spark, d, "benchmark").select("item_id", jsonfix.closest(F.col("text"), kinds).alias("closest"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@add(f"""WITH s AS (SELECT a.vec_id AS query_id, a.label = b.label AS rel, {COS} AS c, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS pos, count(*) FILTER (rel) OVER (PARTITION BY query_id) AS golds, sum(CAST(rel AS INT)) OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS h FROM s),
m AS (SELECT query_id, k, max(golds) AS golds, count(*) FILTER (rel AND pos <= k) AS n, coalesce(sum(h / pos) FILTER (rel AND pos <= k), 0) AS ap, min(pos) FILTER (rel AND pos <= k) AS first, coalesce(sum(1 / log2(pos + 1)) FILTER (rel AND pos <= k), 0) AS dcg FROM r, (VALUES (1), (5), (10)) v(k) GROUP BY 1, 2)
SELECT query_id, k, round(CASE WHEN golds = 0 THEN 0 ELSE n / k END, 6) AS "precision", round(CASE WHEN golds = 0 THEN 1 ELSE n / golds END, 6) AS recall, CAST(n > 0 AS DOUBLE) AS hit, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / k) * (n / golds) / (n / k + n / golds) END, 6) AS f1,
round(CASE WHEN golds = 0 THEN 0 ELSE ap / least(golds, k) END, 6) AS ap, round(coalesce(1.0 / first, 0), 6) AS rr, round(CASE WHEN golds = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(golds, k) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM m""")
def ranking_at_k(spark, d):
    from .vectors import nearest

    r, golds = nearest(spark, d, 10)
    m = evaluation.ranking(r.join(golds, "query_id"), "query_id", "rank", F.col("rel"), F.col("golds"))
    return m.select("query_id", "k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "hit", "f1", "ap", "rr", "ndcg")))


@add("""WITH s AS (SELECT lang, source, CASE WHEN count(*) > 2 THEN round(avg(n_chars), 6) END AS score FROM documents GROUP BY 1, 2) SELECT lang, count(*) AS datasets, count(*) FILTER (score IS NULL) AS missing, round(avg(score), 4) AS mean FROM s GROUP BY lang""")
def score_report(spark, d):
    s = table(spark, d, "documents").groupBy("lang", "source").agg(F.when(F.count("*") > 2, F.round(F.avg("n_chars"), 6)).alias("score"))
    return evaluation.score_report(s, "lang", "score").select("lang", "datasets", "missing", F.round("mean", 4).alias("mean"))


@add("""WITH s AS (SELECT event_type, user_id % 4 AS part, 'score' AS metric, avg(value) AS v FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, user_id % 4, 'evaluation_time', sum(value) FROM events GROUP BY 1, 2)
SELECT event_type, metric, round(CASE metric WHEN 'score' THEN sum(v) / 4 ELSE sum(v) END, 4) AS v FROM s GROUP BY 1, 2 HAVING count(*) = 4""")
def merged_benchmark_parts(spark, d):
    g = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("part")).agg(F.avg("value").alias("score"), F.sum("value").alias("evaluation_time"))
    s = g.unpivot(["event_type", "part"], ["score", "evaluation_time"], "metric", "v")
    return evaluation.merged_parts(s, ["event_type"], "metric", "v", 4).select("event_type", "metric", F.round("v", 4).alias("v"))


@add("""WITH x AS (SELECT c_custkey, 'n' || c_nationkey AS title, c_name AS body FROM customer) SELECT title, title || chr(10) || string_agg(body, chr(10) ORDER BY c_custkey) AS text FROM x GROUP BY title""")
def merged_passages(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey"), F.lit("\n"), "c_name").alias("passage"))
    return captions.merge_first_lines(p, "passage", "c_custkey")


@add("""SELECT conv_id, turn, trim(replace(replace(text, chr(8217), ''''), chr(8212), '-')) AS shown FROM conversations WHERE role = 'user'""")
def rendered_turns(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.render(F.array(T.plain(F.col("text")), T.plain(F.col("text"))), "A1_NOBODYATALL").alias("shown"))
