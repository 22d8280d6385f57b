"""Located entities against a free-text query: visible evidence, lexical score, rank and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T

# Whole phrase of several words, of one word, share of words; prior of mentions; named location.
PHRASE, WORD, OVERLAP, PRIOR, NAMED = 1.0, 0.9, 0.75, 0.08, 1.25


def visible_evidence(mentions: DataFrame, key: list[str], time: str, until: Column | int | str) -> DataFrame:
    """key, first_seen, visible: entities seen at or before until, with their mentions up to then; no list of times is built."""
    g = mentions.groupBy(*key).agg(F.min(time).alias("first_seen"), F.count_if(F.col(time) <= until).alias("visible"))
    return g.where((F.col("first_seen") <= until) & (F.col("visible") > 0))


def raw_score(surface: Column, mentions: Column, location: Column, query: Column) -> Column:
    """Lexical fit times evidence and location; null where the entity shares no word with the query."""
    q, s = T.tokens(query), T.tokens(surface)
    words = F.array_distinct(s)
    share = F.size(F.array_intersect(words, F.array_distinct(q)))
    base = F.when(T.has_phrase(q, s), F.when(F.size(words) > 1, PHRASE).otherwise(WORD)).when(share > 0, OVERLAP * share / F.size(words))
    named = F.when(T.has_phrase(q, T.tokens(F.replace(location, F.lit("_"), F.lit(" ")))), NAMED).otherwise(1.0)
    return base * (1 + PRIOR * F.log1p(F.greatest(mentions, F.lit(0)))) * named


def lexical_rank(entities: DataFrame, key: str, surface: str, mentions: str, location: str, query: str, k: int | None = None) -> DataFrame:
    """entities with score (the best one's is 1), those without a common word left out; with k the best so many in order, ties to the smaller key."""
    s = entities.withColumn("score", raw_score(F.col(surface), F.col(mentions), F.col(location), F.lit(query))).where("score is not null")
    out = s.crossJoin(F.broadcast(s.agg(F.max("score").alias("_top")))).withColumn("score", F.col("score") / F.col("_top")).drop("_top")  # one row
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def display(entity: Column, surface: Column, location: Column, mentions: Column) -> Column:
    """One line of an entity for a prompt."""
    return F.format_string("%s: %s (%s, %s mentions)", entity, surface, F.replace(location, F.lit("_"), F.lit(" ")), mentions.cast("string"))


def which_one(surface: Column, locations: Column) -> Column:
    """Question that tells entities of one surface form apart by their locations; null for fewer than two."""
    named = F.transform(F.array_distinct(locations), lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    return F.when(F.size(named) > 1, F.concat(F.lit("Which "), surface, F.lit(" do you mean: the one at "), F.array_join(named, " or "), F.lit("?")))
