"""As-of, interval and point-in-interval joins, as equi-joins on buckets or one ordered pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with values of the latest right row at or before left_time, null if none.

    Both sides go through one window over by in order of time: one shuffle, no pairs.  Of right rows at
    one time, the last in order of values counts.
    """
    lcols = left.columns
    a = left.select(*lcols, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("_got", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return u.select(*lcols, *(F.col("_got")[v].alias(v) for v in values))


def _cells(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("bigint"), F.floor(end / width).cast("bigint")))


def overlap(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, width: float) -> DataFrame:
    """Pairs with re > ls and rs < le (half-open), met in cells of the given width; each pair once, in the later start's cell."""
    a = left.withColumn("_cell", _cells(F.col(ls), F.col(le), width))
    b = right.withColumn("_cell", _cells(F.col(rs), F.col(re), width))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width).cast("bigint")
    return a.join(b, "_cell").where((F.col(re) > F.col(ls)) & (F.col(rs) < F.col(le)) & (F.col("_cell") == first)).drop("_cell")


def containing(slots: DataFrame, entries: DataFrame, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Entries wholly inside a slot [slot * width, (slot + 1) * width]; those across an edge are lost, by definition."""
    e = entries.withColumn("slot", F.floor(F.col(start) / width).cast("bigint")).where(F.col(end) <= (F.col("slot") + 1) * width)
    return e.join(slots, "slot")


def cascade(left: DataFrame, lookups: list[tuple[DataFrame, str]], value: str) -> DataFrame:
    """left with value from the first lookup (table, key column of both sides) that has it, in order; of repeated keys the largest."""
    for i, (table, key) in enumerate(lookups):
        one = table.groupBy(key).agg(F.max(value).alias(f"_v{i}"))
        left = left.join(one, key, "left")
    names = [f"_v{i}" for i in range(len(lookups))]
    return left.withColumn(value, F.coalesce(*names)).drop(*names)


def required(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with right's value; the query fails on a row without a match."""
    j = left.join(right.select(key, value, F.lit(True).alias("_found")), key, "left")
    found = F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(right.schema[value].dataType))
    return j.withColumn(value, found).drop("_found")


def or_empty(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with right's array, empty where there is none."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.array().cast(right.schema[value].dataType)))


def coverage(items: DataFrame, by: str, key: str, vectors: DataFrame, vec: str) -> DataFrame:
    """status and groups: how many groups have vectors of all members (covered), of some (partial), of none (missing)."""
    g = items.join(vectors.select(key, vec), key, "left").groupBy(by).agg(F.count(vec).alias("_h"), F.count("*").alias("_n"))
    return g.groupBy(F.when(F.col("_h") == 0, "missing").when(F.col("_h") < F.col("_n"), "partial").otherwise("covered").alias("status")).agg(F.count("*").alias("groups"))


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns, rows without a match left out."""
    return left.join(right, key)


def verification(entries: DataFrame, store: DataFrame, key: str, value: str) -> DataFrame:
    """One row: hits and misses of entries in the store, keys that several entries share, store keys nobody claims, and hits of equal value (null-safe)."""
    e = entries.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_a"), F.lit(True).alias("_e"))
    s = store.groupBy(key).agg(F.min(value).alias("_b"), F.lit(True).alias("_s"))
    j = e.join(s, key, "full")
    both = F.col("_e").isNotNull() & F.col("_s").isNotNull()
    return j.agg(
        F.coalesce(F.sum(F.when(both, F.col("_n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("_n"))), F.lit(0)).alias("misses"),
        F.count_if(F.col("_n") > 1).alias("collisions"), F.count_if(F.col("_e").isNull()).alias("unclaimed"), F.count_if(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"),
    )


def rebuilt(captions: DataFrame, cache: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value, origin of the distinct keys of captions: what the cache keeps, else the first source that has it; others go."""
    out = captions.select(key).distinct()
    for i, t in enumerate([cache, *sources]):
        out = out.join(t.groupBy(key).agg(F.max(value).alias(f"_v{i}")), key, "left")
    names = [f"_v{i}" for i in range(len(sources) + 1)]
    origin = F.coalesce(*(F.when(F.col(n).isNotNull(), "cache" if not i else f"source {i}") for i, n in enumerate(names)))
    return out.select(key, F.coalesce(*names).alias(value), origin.alias("origin")).where(F.col(value).isNotNull())


def by_path_or_stem(files: DataFrame, videos: DataFrame, path: str, video: str) -> DataFrame:
    """files with video: the one of equal relative path without suffix, else of equal stem; of several the smallest."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    stem = lambda c: F.regexp_extract(bare(c), r"([^/]*)$", 1)
    f = files.withColumn("_p", bare(F.col(path))).withColumn("_s", stem(F.col(path)))
    a, b = (videos.groupBy(k(F.col(video)).alias(n)).agg(F.min(video).alias(v)) for k, n, v in ((bare, "_p", "_a"), (stem, "_s", "_b")))
    return f.join(a, "_p", "left").join(b, "_s", "left").withColumn("video", F.coalesce("_a", "_b")).drop("_p", "_s", "_a", "_b")


def pooled(items: DataFrame, by: str, key: str, vectors: DataFrame, vec: str) -> DataFrame:
    """by, vec (mean of the members' vectors, null if none), covered and missing members.  items: by, key."""
    j = items.join(vectors.select(key, vec), key, "left")
    n = j.groupBy(by).agg(F.count(vec).alias("covered"), F.count_if(F.col(vec).isNull()).alias("missing"))
    x = j.where(F.col(vec).isNotNull()).select(by, F.posexplode(vec).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    mean = x.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_m")).select(by, F.col("_m._x").alias(vec))
    return n.join(mean, by, "left").select(by, vec, "covered", "missing")
