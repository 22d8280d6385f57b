"""Timelines, chunks, windows and time joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.operators import joins, sampling, sequences
from chronoloom.streaming import sessions

from .base import TIMELINE, Registry, table, timeline

QUERIES = Registry()
add = QUERIES.add
GAP, HALF = 14_400.0, 5

SEGMENTS = f"""{TIMELINE}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS new FROM timeline),
seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS segment FROM g)"""


@add(f"WITH {SEGMENTS} SELECT user_id, segment, min(t) AS start, max(t) AS end_, count(*) AS events FROM seg GROUP BY user_id, segment")
def gap_segments(spark, d):
    s = sequences.gap_segments(timeline(spark, d), "user_id", "t", "event_id", GAP)
    return s.groupBy("user_id", F.col("segment").cast("bigint").alias("segment")).agg(F.min("t").alias("start"), F.max("t").alias("end_"), F.count("*").alias("events"))


@add("""WITH p AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(0.5 * list_sum(list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / 2 + 0.5 * list_avg(list_transform(list_zip(a, b), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS distance FROM p WHERE b IS NOT NULL""")
def adjacent_distance(spark, d):
    e = sampling.numbered(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    near = e.where("embedding is not null").select((F.col("_i") + 1).alias("_i"), F.col("embedding").alias("b"))  # the row before by rank: an equi-join, no single-task window
    diff = F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)
    return e.join(near, "_i").select("vec_id", F.round(0.5 * total / 2 + 0.5 * total / F.size("embedding"), 6).alias("distance"))


def _scored(spark, d):
    t = timeline(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    t = t.withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("gap", F.col("t") - F.lag("t").over(w) > GAP).where("d is not null")
    return sequences.robust_z(t, "user_id", ["t", "event_id"], "d", HALF)


DIST = f"{TIMELINE}, dist AS (SELECT * FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS d FROM timeline) WHERE d IS NOT NULL)"
ROBUST = f"""{DIST}, f AS (SELECT user_id, greatest(0.05 * median(d), 1e-6) AS floor FROM dist GROUP BY user_id),
w AS (SELECT *, median(d) OVER x AS m, mad(d) OVER x AS mad, count(*) OVER x AS n FROM dist WINDOW x AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING))"""


@add(f"WITH {ROBUST} SELECT event_id, round(CASE WHEN n >= 3 THEN (d - m) / greatest(1.4826 * mad, floor) END, 6) AS z FROM w JOIN f USING (user_id)")
def rolling_robust_z(spark, d):
    return _scored(spark, d).select("event_id", F.round("z", 6).alias("z"))


@add(None)
def boundary_cuts(spark, d):
    return sequences.boundary_cuts(_scored(spark, d), "user_id", 2.0, 1.0, 3600.0, 864_000.0)


@add(None)
def threshold_sweep(spark, d):
    s = _scored(spark, d)
    out = None
    for x in (2.0, 4.0, 8.0):  # a fixed list of settings
        n = sequences.boundary_cuts(s, "user_id", x, 1.0, 3600.0, 864_000.0).groupBy("origin").agg(F.count("*").alias("cuts")).withColumn("threshold", F.lit(x))
        out = n if out is None else out.unionByName(n)
    return out


@add("""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS part FROM conversations)
SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS turns, max(turn) AS last_turn, string_agg(trim(text), ' ' ORDER BY turn) AS text, 'chunk-' || md5(string_agg(trim(text), ' ' ORDER BY turn)) AS chunk_id FROM p GROUP BY conv_id, part""")
def fixed_grid_chunks(spark, d):
    c = sequences.count_groups(table(spark, d, "conversations"), "conv_id", ["turn"], 3)
    g = c.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.sort_array(F.collect_list(F.struct("turn", F.trim("text").alias("x")))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: v["x"]), " ")
    return g.select("conv_id", "part", "turns", "last_turn", text.alias("text"), T.content_id(text).alias("chunk_id"))


@add(f"""WITH RECURSIVE {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM timeline),
n AS (SELECT user_id, event_id, i, t, t AS first, CAST(0 AS BIGINT) AS node FROM r WHERE i = 1 UNION ALL
SELECT r.user_id, r.event_id, r.i, r.t, CASE WHEN r.t - n.first > 604800 THEN r.t ELSE n.first END, n.node + CASE WHEN r.t - n.first > 604800 THEN 1 ELSE 0 END FROM n JOIN r ON r.user_id = n.user_id AND r.i = n.i + 1)
SELECT user_id, node, count(*) AS events, min(t) AS start, max(t) AS end_ FROM n GROUP BY user_id, node""")
def elapsed_nodes(spark, d):
    n = sequences.elapsed_nodes(timeline(spark, d).withColumn("e", F.col("t")), ["user_id"], "t", "e", "event_id", 604_800.0)
    return n.groupBy("user_id", "node").agg(F.count("*").alias("events"), F.min("t").alias("start"), F.max("t").alias("end_"))


@add(f"""WITH {TIMELINE}, edges AS (SELECT user_id, t, max(event_id) AS edge FROM timeline WHERE event_type = 'error' GROUP BY user_id, t)
SELECT e.event_id, x.edge FROM (SELECT * FROM timeline WHERE event_type <> 'error') e ASOF LEFT JOIN edges x ON e.user_id = x.user_id AND e.t >= x.t""")
def midpoint_asof_bucket(spark, d):
    t = timeline(spark, d)
    edges = t.where("event_type = 'error'").select("user_id", "t", F.col("event_id").alias("edge"))
    return joins.asof(t.where("event_type <> 'error'").select("event_id", "user_id", "t"), edges, ["user_id"], "t", "t", ["edge"]).select("event_id", "edge")


@add("""WITH s AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS snap FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT q.o_orderkey, s.snap FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') q ASOF LEFT JOIN s ON q.o_custkey = s.o_custkey AND q.o_orderdate >= s.o_orderdate""")
def latest_snapshot_asof(spark, d):
    o = table(spark, d, "orders")
    snaps = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("snap"))
    return joins.asof(o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate"), snaps, ["o_custkey"], "o_orderdate", "o_orderdate", ["snap"]).select("o_orderkey", "snap")


DAYS = "s AS (SELECT user_id, segment, min(t) AS a, max(t) AS b FROM seg GROUP BY 1, 2), w AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS day FROM timeline)"


@add(f"WITH {SEGMENTS}, {DAYS} SELECT user_id, segment, day FROM s JOIN w ON b > day * 86400.0 AND a < (day + 1) * 86400.0")
def interval_overlap_join(spark, d):
    t = timeline(spark, d)
    s = sequences.gap_segments(t, "user_id", "t", "event_id", GAP).groupBy("user_id", F.col("segment").cast("bigint").alias("segment")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = t.select(F.floor(F.col("t") / 86400).cast("bigint").alias("day")).distinct().withColumn("ws", F.col("day") * 86400.0).withColumn("we", (F.col("day") + 1) * 86400.0)
    return joins.overlap(s, w, "a", "b", "ws", "we", 86400.0).select("user_id", "segment", "day")


@add(f"WITH {SEGMENTS}, {DAYS} SELECT day AS slot, count(*) AS inside FROM s JOIN w ON a >= day * 86400.0 AND a < (day + 1) * 86400.0 AND b <= (day + 1) * 86400.0 GROUP BY day")
def slot_containment_join(spark, d):
    t = timeline(spark, d)
    s = sequences.gap_segments(t, "user_id", "t", "event_id", GAP).groupBy("user_id", "segment").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    slots = t.select(F.floor(F.col("t") / 86400).cast("bigint").alias("slot")).distinct()
    return joins.containing(slots, s, 86400.0).groupBy("slot").agg(F.count("*").alias("inside"))


@add(f"WITH {SEGMENTS}, s AS (SELECT user_id, segment, min(t) AS a, max(t) AS b FROM seg GROUP BY 1, 2) SELECT e.event_id, coalesce(min(s.segment), 0) AS first_segment FROM timeline e LEFT JOIN s ON s.user_id = e.user_id AND e.t + 60 BETWEEN s.a AND s.b GROUP BY e.event_id")
def point_in_first_interval(spark, d):
    t = timeline(spark, d)
    s = sequences.gap_segments(t, "user_id", "t", "event_id", GAP).groupBy("user_id", F.col("segment").cast("bigint").alias("segment")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    p = joins.asof(t.select("event_id", "user_id", (F.col("t") + 60).alias("t")), s, ["user_id"], "t", "a", ["segment", "b"])  # a user's segments do not overlap
    return p.select("event_id", F.when(F.col("t") <= F.col("b"), F.col("segment")).otherwise(0).cast("bigint").alias("first_segment"))


@add("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN role = 'user' THEN role END AS cue FROM conversations),
l AS (SELECT *, last_value(CASE WHEN cue IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upon FROM r)
SELECT conv_id, turn, CASE WHEN i - upon <= 1 THEN 'user' END AS carried FROM l""")
def carry_forward_labels(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return sequences.carry_forward(c, "conv_id", "turn", F.filter(F.array(F.when(F.col("role") == "user", F.col("role"))), lambda x: x.isNotNull()), 1).select("conv_id", "turn", "carried")


@add(f"WITH {SEGMENTS} SELECT user_id, CAST(floor(min(t)) AS BIGINT) AS start, count(*) AS events, round(sum(value), 4) AS value FROM seg GROUP BY user_id, segment")
def activity_sessions(spark, d):
    s = sessions.activity_sessions(table(spark, d, "events"), f"{int(GAP)} seconds")
    return s.select("user_id", F.floor(F.unix_micros("start") / 1e6).cast("bigint").alias("start"), "events", F.round("value", 4).alias("value"))


@add("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return sessions.windowed_counts(table(spark, d, "events"), "1 day").select(F.unix_seconds("start").alias("day"), "event_type", "events")
