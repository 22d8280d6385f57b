"""Evaluation statistics: summaries, intervals, paired tests, ranking and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the score interval, within 0..1; (0, 0) for n = 0."""
    p, d = k / n, 1 + Z * Z / n
    mid, half = (p + Z * Z / (2 * n)) / d, Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p: min(1, 2 * P(at most min(b, c) of b + c coin flips)), through logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    # log C(n, i) step by step, so nothing overflows
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("log")),
        lambda a, i: F.struct((a["sum"] + F.exp(F.when(i == 0, 0.0).otherwise(a["log"] + F.log((n - i + 1) / i)) - n * F.log(F.lit(2.0)))).alias("sum"), F.when(i == 0, 0.0).otherwise(a["log"] + F.log((n - i + 1) / i)).alias("log")),
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms["sum"]))


def zero_safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confidence(n: Column, margin: Column, saturation: float = 0.20, crowding: float = 0.05) -> Column:
    """min(margin / saturation, 1) / (1 + crowding * (n - 2)); under two matches it is 1."""
    return F.when(n < 2, 1.0).otherwise(F.least(F.greatest(margin, F.lit(0.0)) / saturation, F.lit(1.0)) / (1 + crowding * (n - 2)))


def ranking(ranked: DataFrame, query: str, rank: str, relevant: Column, golds: Column, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """query, k and the metrics at k of one ranked table: precision, recall, hit, F1, AP (by the lesser of golds and k), reciprocal rank, linear NDCG.

    relevant: of the row; golds: how many relevant items the query has, found or not.
    """
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    r = ranked.select(query, F.col(rank), relevant.cast("int").alias("_hit"), golds.alias("_g"))
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(rank))).withColumn("_h", F.sum("_hit").over(w))
    at = r.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("_in", (F.col("_r") <= F.col("k")) & (F.col("_hit") == 1))
    g = at.groupBy(query, "k").agg(
        F.max("_g").alias("_g"), F.count_if("_in").alias("_n"), F.sum(F.when(F.col("_in"), F.col("_h") / F.col("_r")).otherwise(0.0)).alias("_ap"),
        F.min(F.when(F.col("_in"), F.col("_r"))).alias("_first"), F.sum(F.when(F.col("_in"), 1 / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias("_dcg"),
    )
    few = F.least("_g", "k")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(few, F.lit(1)).cast("bigint")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    p, c = F.col("_n") / F.col("k"), F.when(F.col("_g") == 0, 1.0).otherwise(F.col("_n") / F.col("_g"))
    return g.select(
        query, "k", F.when(F.col("_g") == 0, 0.0).otherwise(p).alias("precision"), c.alias("recall"), (F.col("_n") > 0).cast("double").alias("hit"),
        zero_safe(2 * p * c, p + c).alias("f1"), zero_safe(F.col("_ap"), few).alias("ap"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("rr"), zero_safe(F.col("_dcg"), F.when(few == 0, 0.0).otherwise(ideal)).alias("ndcg"),
    )


# Responses that stand for a failure of the pipeline.
FAILURES = ("Error", "Unable to generate answer")


def failed(flag: Column, response: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.trim(response).isin(*FAILURES), F.lit(False))


def summary(results: DataFrame) -> DataFrame:
    """One row of counts and rates of results (failed, response, abstained, evaluate)."""
    bad = failed(F.col("failed"), F.col("response"))
    n = results.agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"), F.count_if(F.coalesce("abstained", F.lit(False)) & ~bad).alias("abstained"), F.count_if("evaluate").alias("correct"))
    n = n.withColumn("answered", F.col("total") - F.col("abstained") - F.col("failed")).withColumn("wrong", F.col("answered") - F.col("correct"))
    rate = lambda a, b: zero_safe(F.col(a), F.col(b))
    return n.select("*", rate("correct", "answered").alias("accuracy_answered"), rate("correct", "total").alias("accuracy_overall"), rate("abstained", "total").alias("abstention_rate"), rate("wrong", "total").alias("hallucination_rate"))


def paired(base: DataFrame, system: DataFrame, key: str) -> DataFrame:
    """key, base_ok, abstained, system_ok, outcome of the results that both arms have; a failure in either gives excluded_failure."""
    arm = lambda d, p: d.select(key, failed(F.col("failed"), F.col("response")).alias(f"{p}_bad"), F.coalesce("evaluate", F.lit(False)).alias(f"{p}_ok"), F.coalesce("abstained", F.lit(False)).alias(f"{p}_abstained"))
    j = arm(base, "base").join(arm(system, "system"), key)
    b, s = F.col("base_ok"), F.col("system_ok")
    cell = (
        F.when(F.col("base_bad") | F.col("system_bad"), "excluded_failure").when(F.col("system_abstained") & b, "abstain_baseline_right").when(F.col("system_abstained"), "abstain_baseline_wrong")
        .when(b & s, "both_right").when(b, "system_lost").when(s, "system_gained").otherwise("both_wrong")
    )
    return j.select(key, "base_ok", F.col("system_abstained").alias("abstained"), "system_ok", cell.alias("outcome"))


def paired_rates(pairs: DataFrame) -> DataFrame:
    """One row: pairs that count, shares of abstentions over a right and a wrong baseline, and precision of abstaining."""
    n = pairs.where("outcome <> 'excluded_failure'").agg(F.count("*").alias("n"), F.count_if(F.expr("outcome = 'abstain_baseline_right'")).alias("_o"), F.count_if(F.expr("outcome = 'abstain_baseline_wrong'")).alias("_a"))
    return n.select("n", zero_safe(F.col("_o"), F.col("n")).alias("over_triggering"), zero_safe(F.col("_a"), F.col("n")).alias("avoided"), zero_safe(F.col("_a"), F.col("_o") + F.col("_a")).alias("precision"))


def by_type(pairs: DataFrame, kind: str) -> DataFrame:
    """kind, n, accuracy of the baseline, of the system where it answered, and share of abstentions; failures left out."""
    g = pairs.where("outcome <> 'excluded_failure'").groupBy(F.coalesce(kind, F.lit("unknown")).alias(kind)).agg(F.count("*").alias("n"), F.count_if("base_ok").alias("_b"), F.count_if("abstained").alias("_a"), F.count_if("system_ok").alias("_s"))
    return g.select(kind, "n", (F.col("_b") / F.col("n")).alias("base_accuracy"), zero_safe(F.col("_s"), F.col("n") - F.col("_a")).alias("system_accuracy"), (F.col("_a") / F.col("n")).alias("abstention"))


def answer_scores(prediction: Column, golds: Column) -> tuple[Column, Column]:
    """Exact match and token F1 of short answers, the best over the golds; both compare answer forms."""
    words = lambda t: F.filter(F.split(T.answer_form(t), " "), lambda w: w != "")
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    p = words(prediction)

    def f1(gold: Column) -> Column:
        g = words(gold)
        both = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(times(p, w), times(g, w)))
        return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))

    em = F.exists(golds, lambda g: T.answer_form(g) == T.answer_form(prediction)).cast("double")
    return F.coalesce(em, F.lit(0.0)), F.coalesce(F.array_max(F.transform(golds, f1)), F.lit(0.0))


def exponential_ndcg(grades: Column, k: int) -> Column:
    """NDCG at k of graded relevance in ranked order, gains 2^grade - 1; 0 without any gain."""
    dcg = lambda xs: F.aggregate(F.zip_with(F.slice(xs, 1, k), F.sequence(F.lit(1), F.lit(k)), lambda g, i: F.when(g.isNull(), 0.0).otherwise((F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1.0))), F.lit(0.0), lambda s, x: s + x)
    return zero_safe(dcg(grades), dcg(F.sort_array(grades, asc=False)))


def score_report(scores: DataFrame, by: str, score: str) -> DataFrame:
    """by, datasets, missing, mean of the scores there are."""
    return scores.groupBy(by).agg(F.count("*").alias("datasets"), F.count_if(F.col(score).isNull()).alias("missing"), F.avg(score).alias("mean"))


def merged_parts(scores: DataFrame, by: list[str], metric: str, score: str, parts: int, additive: tuple[str, ...] = ("evaluation_time",)) -> DataFrame:
    """by, metric, score over the parts of a benchmark: the mean over all parts, a sum for additive metrics; only where all parts are there."""
    g = scores.groupBy(*by, metric).agg(F.sum(score).alias("_s"), F.count("*").alias("_n")).where(F.col("_n") == parts)
    return g.select(*by, metric, F.when(F.col(metric).isin(*additive), F.col("_s")).otherwise(F.col("_s") / parts).alias(score))
