"""Facts, mapping, records, entities and text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.operators import facts, joins, lexical
from chronoloom.sources import records

from .base import TRIPLES, Registry, table, triples

QUERIES = Registry()
add = QUERIES.add


def _norm(x: str) -> str:
    edge = r"""[\s"''`.,;:!?()\[\]{}\-]+"""
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^{edge}', ''), '{edge}$', ''), '^(the|a|an)\\s+', '', 'i')))"


def _fold(x: str) -> str:
    return f"CASE WHEN {_norm(x)} IN ('i','me','my','myself','mine') THEN 'i' ELSE {_norm(x)} END"


FACTS = f"""{TRIPLES}, keyed AS (SELECT {_fold('s')} AS ks, {_fold('p')} AS kp, {_fold('o')} AS ko, node FROM triples),
facts AS (SELECT ks, kp, ko, min(node) AS first_seen, max(node) AS last_seen, count(*) AS support FROM keyed
  WHERE NOT (ks = '' OR (kp = '' AND ko = '') OR (ko <> '' AND ks = ko)) GROUP BY ks, kp, ko)"""


@add(f"WITH {FACTS} SELECT ks, kp, ko, first_seen, last_seen, support FROM facts WHERE first_seen <= '199612'")
def interval_store_snapshot(spark, d):
    return facts.snapshot(facts.fold_facts(triples(spark, d)), "199612").drop("variants")


@add(f"""WITH {FACTS} SELECT count(*) AS facts, CAST(sum(support) AS BIGINT) AS support, round(avg(support), 6) AS mean_support, max(support) AS max_support,
count(*) FILTER (support = 1) AS singletons, count(DISTINCT ks) AS subjects, count(DISTINCT kp) AS predicates, count(DISTINCT ko) AS objects,
round(sum(support) / count(*), 6) AS compression FROM facts""")
def interval_store_statistics(spark, d):
    return facts.statistics(facts.fold_facts(triples(spark, d)))


@add(f"""WITH {TRIPLES}, n AS (SELECT node, count(*) AS c FROM triples GROUP BY node), r AS (SELECT sum(c) OVER (ORDER BY node) AS state FROM n)
SELECT count(*) AS nodes, CAST(max(state) AS BIGINT) AS final_triples, CAST(sum(state) AS BIGINT) AS triples_written_upper_bound, round(sum(state) / max(state), 6) AS amplification FROM r""")
def cumulative_baseline(spark, d):
    return facts.cumulative(triples(spark, d))


@add(f"WITH {FACTS}, k AS (SELECT DISTINCT node FROM triples) SELECT node, CAST((SELECT count(*) FROM facts WHERE first_seen <= node) AS BIGINT) AS facts FROM k")
def materialised_state_sizes(spark, d):
    t = triples(spark, d)
    born = facts.fold_facts(t).groupBy(F.col("first_seen").alias("node")).agg(F.count("*").alias("born"))
    nodes = t.select("node").distinct().join(born, "node", "left")  # one row for each node, however many facts
    return nodes.select("node", F.coalesce(F.sum("born").over(Window.orderBy("node")), F.lit(0)).alias("facts"))


@add("""WITH n AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS c FROM orders GROUP BY 1), l AS (SELECT c, lag(c) OVER (ORDER BY m) AS p FROM n)
SELECT count(*) AS months, CAST(sum(c) AS BIGINT) AS written, max(c) AS largest, round(100.0 * count(*) FILTER (c >= p) / count(p), 6) AS growing_pct FROM l""")
def growth_monotonic_share(spark, d):
    n = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("c"))
    n = n.withColumn("p", F.lag("c").over(Window.orderBy("m")))
    return n.agg(F.count("*").alias("months"), F.sum("c").alias("written"), F.max("c").alias("largest"), F.round(F.lit(100.0) * F.count_if(F.col("c") >= F.col("p")) / F.count("p"), 6).alias("growing_pct"))


@add("SELECT 'chunk-' || md5(text) AS chunk_id, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_id_collisions(spark, d):
    g = table(spark, d, "documents").groupBy(T.content_id(F.col("text")).alias("chunk_id"))
    return g.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("copies > 1")


@add("""WITH c AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), r AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM c SEMI JOIN r USING (doc_id)) AS hits, (SELECT count(*) FROM c ANTI JOIN r USING (doc_id)) AS misses, (SELECT count(*) FROM r ANTI JOIN c USING (doc_id)) AS unclaimed""")
def mapping_verification(spark, d):
    c = table(spark, d, "documents").where("lang = 'en'").select("doc_id").distinct()
    r = table(spark, d, "labels").select("doc_id").distinct()
    both = c.withColumn("c", F.lit(1)).join(r.withColumn("r", F.lit(1)), "doc_id", "full")
    return both.agg(F.count_if(F.expr("c = 1 and r = 1")).alias("hits"), F.count_if(F.expr("c = 1 and r is null")).alias("misses"), F.count_if(F.expr("c is null")).alias("unclaimed"))


@add("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_record_wins(spark, d):
    return records.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", F.col("event_id")).select("user_id", "event_id", "event_type", "value")


@add("SELECT doc_id, lang, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def pending_anti_join(spark, d):
    return records.pending(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels"), "doc_id")


@add("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents WHERE trim(text) <> '' GROUP BY text")
def exact_dedupe_text(spark, d):
    docs = table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.md5("text").alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@add("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def shared_ids(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id").intersect(table(spark, d, "documents").where("lang = 'en'").select("doc_id"))


@add("SELECT doc_id AS id, 'document' AS kind, n_chars AS size FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark")
def unioned_sources(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("n_chars").alias("size"))
    return a.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"), F.length("text").cast("bigint").alias("size")))


def _mentions(spark, d):
    li, su, pa, na = (table(spark, d, n) for n in ("lineitem", "supplier", "part", "nation"))
    return (
        li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(pa, F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.lower("p_type").alias("surface"), F.col("n_name").alias("location"), F.date_format("l_shipdate", "yyyyMMdd").cast("bigint").alias("at"), "l_orderkey")
    )


def _bank(spark, d):
    m = _mentions(spark, d)
    bank = m.groupBy("surface", "location").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n_mentions"), F.countDistinct("l_orderkey").alias("n_chunks"))
    k = F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("n_mentions"), "location")) - 1
    return bank.withColumn("entity_id", F.concat(F.lit("ent-"), F.col("surface"), F.lit("-"), k.cast("string")))


MENTIONS = """m AS (SELECT lower(p_type) AS surface, n_name AS location, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS seen, l_orderkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT surface, location, min(seen) AS first_seen, max(seen) AS last_seen, count(*) AS n_mentions, count(DISTINCT l_orderkey) AS n_chunks, list_sort(list(seen)) AS times FROM m GROUP BY 1, 2),
bank AS (SELECT *, 'ent-' || surface || '-' || (row_number() OVER (PARTITION BY surface ORDER BY n_mentions DESC, location) - 1) AS entity_id FROM b)"""


@add(f"WITH {MENTIONS} SELECT entity_id, surface, location, first_seen, last_seen, n_mentions, n_chunks FROM bank")
def entity_bank(spark, d):
    return _bank(spark, d).select("entity_id", "surface", "location", "first_seen", "last_seen", "n_mentions", "n_chunks")


@add(f"""WITH {MENTIONS}, s AS (SELECT surface, count(*) AS locations, min(n_mentions) AS least FROM bank GROUP BY surface)
SELECT count(*) AS surfaces, count(*) FILTER (locations >= 2) AS ambiguous, count(*) FILTER (locations BETWEEN 2 AND 3 AND least >= 2) AS usable, max(locations) AS most FROM s""")
def ambiguity_budget(spark, d):
    s = _bank(spark, d).groupBy("surface").agg(F.count("*").alias("locations"), F.min("n_mentions").alias("least"))
    return s.agg(F.count("*").alias("surfaces"), F.count_if(F.expr("locations >= 2")).alias("ambiguous"), F.count_if(F.expr("locations between 2 and 3 and least >= 2")).alias("usable"), F.max("locations").alias("most"))


@add(f"WITH {MENTIONS} SELECT surface, location, first_seen, CAST(len(list_filter(times, lambda x: x <= 19970101)) AS BIGINT) AS visible FROM bank WHERE first_seen <= 19970101")
def time_gated_entities(spark, d):
    return lexical.visible_evidence(_mentions(spark, d), ["surface", "location"], "at", 19970101)


ASKED = "Where is the large economy box, or the brushed steel one, that stood in nation 3?"


@add(f"""WITH {MENTIONS}, x AS (SELECT entity_id, n_mentions, regexp_extract_all(surface, '[a-z0-9'']+') AS s, regexp_extract_all(lower(replace(location, '_', ' ')), '[a-z0-9'']+') AS l, regexp_extract_all(lower('{ASKED}'), '[a-z0-9'']+') AS q FROM bank),
y AS (SELECT *, ' ' || array_to_string(q, ' ') || ' ' AS qs, ' ' || array_to_string(s, ' ') || ' ' AS ss, ' ' || array_to_string(l, ' ') || ' ' AS ls, len(list_distinct(s)) AS n, len(list_intersect(list_distinct(s), list_distinct(q))) AS c FROM x),
z AS (SELECT entity_id, (CASE WHEN contains(qs, ss) THEN CASE WHEN n > 1 THEN 1.0 ELSE 0.9 END WHEN c > 0 THEN 0.75 * c / n END) * (1 + 0.08 * ln(1 + n_mentions)) * (CASE WHEN contains(qs, ls) THEN 1.25 ELSE 1.0 END) AS raw FROM y)
SELECT entity_id, round(raw / max(raw) OVER (), 6) AS score FROM z WHERE raw IS NOT NULL""")
def lexical_entity_rank(spark, d):
    r = lexical.lexical_rank(_bank(spark, d), "entity_id", "surface", "n_mentions", "location", ASKED)
    return r.select("entity_id", F.round("score", 6).alias("score"))


@add(f"""SELECT page_id, {_norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS body, md5({_fold("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS key FROM pages""")
def normalised_pages(spark, d):
    t = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.lower(T.normalise_text(t)).alias("body"), F.md5(T.fold(t)).alias("key"))


@add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k >= 50")


@add("""WITH k AS (SELECT event_id, (1 + dayofyear(ts) % 9) AS d, strftime(ts, '%H%M%S') AS c, CAST(event_id % 30 AS BIGINT) AS f FROM events)
SELECT event_id, d || c || lpad(CAST(f AS VARCHAR), 2, '0') AS key, round((d - 1) * 86400.0 + CAST(c[1:2] AS INT) * 3600 + CAST(c[3:4] AS INT) * 60 + CAST(c[5:6] AS INT) + f / 30.0, 6) AS seconds,
'DAY' || d || ' ' || c[1:2] || ':' || c[3:4] || ':' || c[5:6] AS human, d || c || lpad(CAST(f AS VARCHAR), 2, '0') AS back FROM k""")
def timestamp_keys(spark, d):
    e = table(spark, d, "events")
    clock = F.concat(F.date_format("ts", "HHmmss"), F.lpad((F.col("event_id") % 30).cast("string"), 2, "0"))
    k = e.select("event_id", K.from_day_clock(F.concat(F.lit("DAY"), (F.dayofyear("ts") % 9 + 1).cast("string")), clock).alias("key"))
    return k.select("event_id", "key", F.round(K.key_seconds(F.col("key")), 6).alias("seconds"), K.human(F.col("key")).alias("human"), K.seconds_key(K.key_seconds(F.col("key"))).alias("back"))


@add("""WITH p AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g')) AS processed FROM documents)
SELECT doc_id, processed, trim(regexp_replace(regexp_replace(processed, '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM p""")
def answer_forms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.processed(F.col("text")).alias("processed"))
    return docs.select("doc_id", "processed", T.answer_form(F.col("processed")).alias("form"))


@add("""WITH k AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders), a AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT c_custkey AS o_custkey, max(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1), c AS (SELECT y, max(o_totalprice) AS v FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY 1)
SELECT o_orderkey, coalesce(a.v, b.v, c.v) AS v FROM k LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_custkey) LEFT JOIN c USING (y)""")
def cascading_lookup(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("v"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("v"))
    c = o.select("y", F.col("o_totalprice").alias("v"))
    return joins.cascade(o.select("o_orderkey", "o_custkey", "y"), [(a, "o_orderkey"), (b, "o_custkey"), (c, "y")], "v").select("o_orderkey", "v")


@add("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def required_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.required(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@add("""WITH t AS (SELECT doc_id, list(DISTINCT quality) AS q FROM labels GROUP BY 1) SELECT doc_id, CAST(coalesce(len(q), 0) AS BIGINT) AS labels FROM documents LEFT JOIN t USING (doc_id)""")
def optional_lookup(spark, d):
    t = table(spark, d, "labels").groupBy("doc_id").agg(F.collect_set("quality").alias("q"))
    return joins.or_empty(table(spark, d, "documents").select("doc_id"), t, "doc_id", "q").select("doc_id", F.size("q").cast("bigint").alias("labels"))


@add("""WITH i AS (SELECT doc_id AS vec_id, source FROM documents), n AS (SELECT source, count(embedding) AS covered, count(*) - count(embedding) AS missing FROM i LEFT JOIN embeddings USING (vec_id) GROUP BY 1),
m AS (SELECT source, avg(CAST(embedding[1] AS DOUBLE)) AS x FROM i JOIN embeddings USING (vec_id) GROUP BY 1) SELECT source, round(x, 6) AS first_part, covered, missing FROM n LEFT JOIN m USING (source)""")
def pooled_sources(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return joins.pooled(i, "source", "vec_id", table(spark, d, "embeddings"), "embedding").select("source", F.round(F.col("embedding")[0], 6).alias("first_part"), "covered", "missing")
