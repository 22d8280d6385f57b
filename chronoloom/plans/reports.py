"""Evaluation arms, reports, verification and filters over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.operators import evaluation as E
from chronoloom.operators import filters, graph, joins, reports, sequences

from .base import TIMELINE, TRIPLES, Registry, table, timeline, triples

QUERIES = Registry()
add = QUERIES.add

RESULTS = """r AS (SELECT doc_id, lang, CASE WHEN doc_id % 41 = 0 THEN true WHEN doc_id % 2 = 0 THEN false END AS failed, CASE WHEN doc_id % 37 = 0 THEN ' Error ' WHEN doc_id % 53 = 0 THEN 'Unable to generate answer' ELSE 'x' END AS response,
  toxic = 1 AS abstained, quality = 1 AS evaluate FROM labels JOIN documents USING (doc_id)),
s AS (SELECT doc_id, lang, doc_id % 43 = 0 AS failed, CASE WHEN doc_id % 31 = 0 THEN 'Error' END AS response, doc_id % 5 = 0 AS abstained, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS evaluate FROM r),
f AS (SELECT *, coalesce(failed, false) OR coalesce(trim(response) IN ('Error', 'Unable to generate answer'), false) AS bad FROM r),
g AS (SELECT *, coalesce(failed, false) OR coalesce(trim(response) IN ('Error', 'Unable to generate answer'), false) AS bad FROM s),
p AS (SELECT f.lang, f.evaluate AS b, g.abstained AS a, g.evaluate AS s, CASE WHEN f.bad OR g.bad THEN 'excluded_failure' WHEN g.abstained AND f.evaluate THEN 'abstain_baseline_right' WHEN g.abstained THEN 'abstain_baseline_wrong'
  WHEN f.evaluate AND g.evaluate THEN 'both_right' WHEN f.evaluate THEN 'system_lost' WHEN g.evaluate THEN 'system_gained' ELSE 'both_wrong' END AS outcome FROM f JOIN g USING (doc_id))"""


def _results(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return r.select(
        "doc_id", "lang", F.expr("case when doc_id % 41 = 0 then true when doc_id % 2 = 0 then false end").alias("failed"), F.expr("case when doc_id % 37 = 0 then ' Error ' when doc_id % 53 = 0 then 'Unable to generate answer' else 'x' end").alias("response"),
        F.expr("toxic = 1").alias("abstained"), F.expr("quality = 1").alias("evaluate"),
    )


def _pairs(spark, d):
    r = _results(spark, d)
    s = r.select("doc_id", F.expr("doc_id % 43 = 0").alias("failed"), F.expr("case when doc_id % 31 = 0 then 'Error' end").alias("response"), F.expr("doc_id % 5 = 0").alias("abstained"), F.expr("doc_id % 3 = 0 and doc_id % 5 <> 0").alias("evaluate"))
    return E.paired(r, s, "doc_id").join(r.select("doc_id", "lang"), "doc_id")


@add(f"""WITH {RESULTS}, n AS (SELECT count(*) AS total, count(*) FILTER (bad) AS failed, count(*) FILTER (abstained AND NOT bad) AS abstained, count(*) FILTER (evaluate) AS correct FROM f), m AS (SELECT *, total - abstained - failed AS answered FROM n)
SELECT *, answered - correct AS wrong, round(correct / answered, 6) AS accuracy_answered, round(correct / total, 6) AS accuracy_overall, round(abstained / total, 6) AS abstention_rate, round((answered - correct) / total, 6) AS hallucination_rate FROM m""")
def evaluation_summary(spark, d):
    rates = ("accuracy_answered", "accuracy_overall", "abstention_rate", "hallucination_rate")
    return E.summary(_results(spark, d)).withColumns({c: F.round(c, 6) for c in rates})


@add(f"WITH {RESULTS} SELECT outcome, count(*) AS n FROM p GROUP BY 1")
def paired_outcomes(spark, d):
    return _pairs(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@add(f"""WITH {RESULTS}, q AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'abstain_baseline_right') AS o, count(*) FILTER (outcome = 'abstain_baseline_wrong') AS a FROM p WHERE outcome <> 'excluded_failure')
SELECT n, round(o / n, 6) AS over_triggering, round(a / n, 6) AS avoided, round(coalesce(a / nullif(o + a, 0), 0), 6) AS "precision" FROM q""")
def paired_rates(spark, d):
    return E.paired_rates(_pairs(spark, d)).withColumns({c: F.round(c, 6) for c in ("over_triggering", "avoided", "precision")})


@add(f"""WITH {RESULTS} SELECT lang, count(*) AS n, round(count(*) FILTER (b) / count(*), 6) AS base_accuracy, round(coalesce(count(*) FILTER (s) / nullif(count(*) - count(*) FILTER (a), 0), 0), 6) AS system_accuracy, round(count(*) FILTER (a) / count(*), 6) AS abstention
FROM p WHERE outcome <> 'excluded_failure' GROUP BY lang""")
def accuracy_by_type(spark, d):
    return E.by_type(_pairs(spark, d), "lang").withColumns({c: F.round(c, 6) for c in ("base_accuracy", "system_accuracy", "abstention")})


@add("SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS duration, count(*) AS total, count(*) FILTER (quality = 1) AS correct, round(count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def accuracy_by_duration(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.expr("case when n_chars < 1000 then 'short' when n_chars < 5000 then 'medium' else 'long' end").alias("duration")), "doc_id")
    return r.groupBy("duration").agg(F.count("*").alias("total"), F.count_if(F.expr("quality = 1")).alias("correct"), F.round(F.count_if(F.expr("quality = 1")) / F.count("*"), 6).alias("accuracy"))


@add("""WITH x AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS g, text FROM benchmark),
y AS (SELECT item_id, list_filter(g, lambda w: w <> '') AS g, list_filter(list_reverse(g)[1:20], lambda w: w <> '') AS p FROM x)
SELECT item_id, CAST(p = g AS DOUBLE) AS em, round(coalesce(2.0 * list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))) / (len(p) + len(g)), 0), 6) AS f1 FROM y""")
def answer_match(spark, d):
    form = T.answer_form(F.col("text"))
    predicted = F.array_join(F.slice(F.reverse(F.split(form, " ")), 1, 20), " ")
    em, f1 = E.answer_scores(predicted, F.array(F.lit("nothing of the kind"), F.col("text")))
    return table(spark, d, "benchmark").select("item_id", em.alias("em"), F.round(f1, 6).alias("f1"))


@add(r"""SELECT conv_id, turn, nullif(upper(regexp_extract(trim(text), '^\(?([A-Za-z])[\.\)]?\s*', 1)), '') AS letter FROM conversations""")
def leading_letters(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.first_letter(F.col("text")).alias("letter"))


@add(f"""WITH {TRIPLES}, f AS (SELECT node, lower(trim(s)) AS s, lower(trim(p)) AS p, lower(trim(o)) AS o FROM triples), c AS (SELECT node, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT '999999', 0),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM f)), e AS (SELECT count(DISTINCT e) AS n FROM (SELECT s AS e FROM f UNION ALL SELECT o FROM f) WHERE e <> '')
SELECT count(*) AS chunks, CAST(sum(c.n) AS BIGINT) AS total, any_value(u.n) AS "unique", round(100.0 * (1 - any_value(u.n) / sum(c.n)), 6) AS duplicate_pct, count(*) FILTER (c.n = 0) AS empty, round(sum(c.n) / count(*), 6) AS mean, any_value(e.n) AS entities FROM c, u, e""")
def episodic_report(spark, d):
    t = triples(spark, d)
    nodes = t.select("node").distinct().unionByName(spark.createDataFrame([("999999",)], "node string"))
    return reports.episodic(t, nodes, "node").withColumns({c: F.round(c, 6) for c in ("duplicate_pct", "mean")})


@add(f"""WITH {TRIPLES}, c AS (SELECT node, count(*) AS n FROM triples WHERE p = 'R' GROUP BY 1), a AS (SELECT DISTINCT node FROM triples)
SELECT count(*) AS nodes, count(n) AS non_empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, round(coalesce(sum(n), 0) / count(*), 6) AS mean FROM a LEFT JOIN c USING (node)""")
def semantic_report(spark, d):
    t = triples(spark, d)
    return reports.semantic(t.where("p = 'R'"), t.select("node"), "node").withColumn("mean", F.round("mean", 6))


@add("""WITH g AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS interval_bytes, CAST(sum(n_chars * (1 + doc_id % 7)) AS BIGINT) AS nested_bytes FROM documents GROUP BY 1)
SELECT *, round(CASE WHEN interval_bytes = 0 THEN 0 ELSE nested_bytes / interval_bytes END, 6) AS reduction FROM g""")
def storage_report(spark, d):
    r = reports.storage(table(spark, d, "documents"), "source", F.length("text"), F.col("n_chars") * (1 + F.col("doc_id") % 7))
    return r.withColumn("reduction", F.round("reduction", 6))


@add("SELECT label, count(*) * 64 * 4 AS raw, CAST(floor(count(*) * 64 * 4 * (1000000.0 / (300 * 64 * 4))) AS BIGINT) AS estimated FROM embeddings GROUP BY label")
def vector_sizes(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    raw, est = reports.vector_bytes(F.col("n"), F.lit(64), F.lit(1000000.0), F.lit(300))
    return n.select("label", raw.alias("raw"), est.alias("estimated"))


@add("WITH g AS (SELECT source, count(*) AS n, avg(n_chars) AS c FROM documents GROUP BY 1) SELECT source, n, round(n * 15.5 * greatest(1.0, c / 2000.0) / 3600, 6) AS hours FROM g")
def cost_projection(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("c"))
    return g.select("source", "n", F.round(reports.cost_hours(F.col("n"), 15.5, F.col("c"), 2000.0), 6).alias("hours"))


@add("""WITH g AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (user_id % 7 = 0) AS silent_empty, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, n, mean, least, most, silent_empty, v[1 + CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)] AS p50, v[1 + CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)] AS p95 FROM g""")
def timing_report(spark, d):
    return reports.timing(table(spark, d, "events"), "event_type", "value", F.expr("user_id % 7 = 0")).withColumn("mean", F.round("mean", 6))


@add("""WITH c AS (SELECT o_orderpriority AS p, CASE o_orderstatus WHEN 'O' THEN 'detected' WHEN 'F' THEN 'cap' ELSE 'gap' END AS o FROM orders)
SELECT p, count(*) AS cuts, count(*) FILTER (o = 'detected') AS detected, count(*) FILTER (o = 'cap') AS capped, count(*) FILTER (o = 'gap') AS gaps, round(100.0 * count(*) FILTER (o = 'detected') / count(*), 6) AS detected_pct FROM c GROUP BY p""")
def cut_origin_counts(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.expr("case o_orderstatus when 'O' then 'detected' when 'F' then 'cap' else 'gap' end").alias("o"))
    return reports.cut_origins(c, "p", "o").withColumn("detected_pct", F.round("detected_pct", 6))


@add("""WITH e AS (SELECT o_custkey AS k, md5(o_orderpriority) AS v FROM orders), s AS (SELECT c_custkey AS k, md5(CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE c_mktsegment END) AS v FROM customer WHERE c_custkey % 3 <> 0),
g AS (SELECT k, count(*) AS n, min(v) AS a FROM e GROUP BY 1), j AS (SELECT g.k AS gk, s.k AS sk, n, a, v FROM g FULL JOIN s ON g.k = s.k)
SELECT CAST(coalesce(sum(n) FILTER (gk IS NOT NULL AND sk IS NOT NULL), 0) AS BIGINT) AS hits, CAST(coalesce(sum(n) FILTER (sk IS NULL), 0) AS BIGINT) AS misses, count(*) FILTER (n > 1) AS collisions, count(*) FILTER (gk IS NULL) AS unclaimed, count(*) FILTER (gk IS NOT NULL AND sk IS NOT NULL AND a IS NOT DISTINCT FROM v) AS equal FROM j""")
def store_verification(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.md5("o_orderpriority").alias("v"))
    s = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.md5(F.expr("case when c_custkey % 2 = 0 then '1-URGENT' else c_mktsegment end")).alias("v"))
    return joins.verification(e, s, "k", "v")


@add("SELECT md5(text) AS key, doc_id, n FROM documents JOIN (SELECT md5(text) AS key, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) t ON md5(text) = t.key")
def chunk_triples(spark, d):
    c = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "lang")
    return joins.matched(c.drop("lang"), c.where("lang = 'en'").groupBy("key").agg(F.count("*").alias("n")), "key")


@add("""WITH j AS (SELECT c_custkey // 2 AS g, count(v.vec_id) AS h, count(*) AS n FROM customer LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0) v ON vec_id = c_custkey GROUP BY 1)
SELECT CASE WHEN h = 0 THEN 'missing' WHEN h < n THEN 'partial' ELSE 'covered' END AS status, count(*) AS groups FROM j GROUP BY 1""")
def pooled_coverage(spark, d):
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("g"), F.col("c_custkey").alias("vec_id"))
    return joins.coverage(c, "g", "vec_id", table(spark, d, "embeddings").where("vec_id % 4 <> 0"), "embedding")


@add("""WITH k AS (SELECT DISTINCT md5(text) AS k FROM documents), a AS (SELECT md5(text) AS k, max(doc_id) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), b AS (SELECT md5(text) AS k, max(-doc_id) AS v FROM documents WHERE lang = 'en' GROUP BY 1), c AS (SELECT md5(text) AS k, max(n_chars) AS v FROM documents WHERE source = 'web' GROUP BY 1)
SELECT k, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'cache' WHEN b.v IS NOT NULL THEN 'source 1' ELSE 'source 2' END AS origin FROM k LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k) WHERE coalesce(a.v, b.v, c.v) IS NOT NULL""")
def rebuilt_cache(spark, d):
    t = table(spark, d, "documents").withColumn("k", F.md5("text"))
    a, b, c = (t.where(w).select("k", x.alias("v")) for w, x in (("doc_id % 3 = 0", F.col("doc_id")), ("lang = 'en'", -F.col("doc_id")), ("source = 'web'", F.col("n_chars"))))
    return joins.rebuilt(t, a, [b, c], "k", "v")


@add("""WITH m AS (SELECT l_orderkey AS chunk, l_partkey AS name FROM lineitem), x AS (SELECT o_orderkey AS chunk FROM orders WHERE o_orderdate >= DATE '1992-06-01'), k AS (SELECT * FROM m WHERE chunk NOT IN (SELECT chunk FROM x))
SELECT (SELECT count(*) FROM k) AS mentions, (SELECT count(DISTINCT name) FROM k) AS names, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT name FROM m) OR p_partkey IN (SELECT name FROM k)) AS facts""")
def deleted_chunks(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("name"))
    gone = table(spark, d, "orders").where("o_orderdate >= date'1992-06-01'").select(F.col("o_orderkey").alias("chunk"))
    t = graph.without_chunks({"facts": table(spark, d, "part").select(F.col("p_partkey").alias("name"))}, m, gone, "chunk", "name")
    return t["mentions"].agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("names")).crossJoin(F.broadcast(t["facts"].agg(F.count("*").alias("facts"))))  # single rows


@add(f"""WITH {TIMELINE}, e AS (SELECT user_id, 'f' || CAST(floor(event_id / 20) AS BIGINT) AS file, t, event_id FROM timeline), f AS (SELECT user_id, file, (row_number() OVER (PARTITION BY user_id ORDER BY min(t), file) - 1) // 2 AS chunk FROM e GROUP BY 1, 2)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(t) AS start, max(t) AS "end" FROM e JOIN f USING (user_id, file) GROUP BY 1, 2""")
def file_grid_chunks(spark, d):
    e = timeline(spark, d).withColumn("file", F.concat(F.lit("f"), F.floor(F.col("event_id") / 20).cast("bigint")))
    return sequences.file_grid(e, "user_id", "file", "t", 2).groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


@add(f"""WITH {TIMELINE}, e AS (SELECT user_id, floor(t / 600) AS t, min(event_id) AS event_id FROM timeline GROUP BY 1, 2) SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 20 AS gap FROM e""")
def stitched_timeline(spark, d):
    e = timeline(spark, d).select("user_id", "event_id", F.floor(F.col("t") / 600).cast("double").alias("t"))
    return sequences.stitched(e, "user_id", "t", "event_id", 20.0)


@add("SELECT event_id, 1 + dayofyear(ts) % 9 AS day, CAST(strftime(ts, '%H%M%S') AS BIGINT) * 100 AS clock, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS seconds FROM events WHERE 1 + dayofyear(ts) % 9 NOT IN (6, 2)")
def frame_clocks(spark, d):
    e = table(spark, d, "events").select("event_id", (1 + F.dayofyear("ts") % 9).alias("day"), (F.date_format("ts", "HHmmss").cast("bigint") * 100 + 7).alias("c"))
    s = K.frame_clock_seconds(F.col("c"))
    return filters.without_days(e, F.col("day"), ("DAY6", 2)).select("event_id", F.col("day").cast("bigint").alias("day"), K.seconds_frame_clock(s).alias("clock"), s.alias("seconds"))


@add("SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id <= 200")
def visible_clips(spark, d):
    return filters.embedded(table(spark, d, "embeddings"), "embedding", "vec_id", 200).select("vec_id")


@add("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 0 ORDER BY doc_id LIMIT 25")
def head_questions(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "ok").otherwise("bad").alias("status"), "n_chars")
    return filters.head(filters.usable(q, "status", "n_chars"), "doc_id", 25).select("doc_id")


@add("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS filled FROM customer")
def prefilled_parts(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    a, b = filters.prefilled(c, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return a.withColumn("filled", F.lit(True)).unionByName(b.withColumn("filled", F.lit(False)))


@add("""WITH e AS (SELECT s_name AS s, CASE WHEN l_returnflag = 'N' THEN '' ELSE p_brand END AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
v AS (SELECT s AS node FROM e WHERE s <> '' UNION SELECT o FROM e WHERE o <> ''), u AS (SELECT s AS a, o AS b FROM e WHERE o <> '' AND s <> o UNION ALL SELECT o, s FROM e WHERE o <> '' AND s <> o)
SELECT node, count(b) AS degree FROM v LEFT JOIN u ON a = node GROUP BY node""")
def entity_degrees(spark, d):
    li, su, pa = (table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    t = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(pa, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("s"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("p_brand")).alias("o"))
    nodes, edges = graph.entity_graph(t)
    return nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").cast("bigint").alias("degree")), "node", "left").fillna(0, ["degree"])
