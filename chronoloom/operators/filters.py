"""Row filters of the engine's inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(day: int | str) -> int:
    digits = "".join(c for c in str(day) if c.isdigit())
    if not digits:
        raise ValueError(f"no day number in {day!r}")
    return int(digits)


def without_days(df: DataFrame, day: Column, excluded: Iterable[int | str] = ("DAY6",)) -> DataFrame:
    """Rows of other days; days as numbers or names such as DAY6."""
    days = [day_number(d) for d in excluded]
    return df.where(~day.isin(*days)) if days else df


def embedded(df: DataFrame, vec: str, end: str, until: Column | int | str) -> DataFrame:
    """Clips with a vector that ended at or before until."""
    return df.where(F.col(vec).isNotNull() & (F.col(end) <= until))


def usable(df: DataFrame, status: str, n: str) -> DataFrame:
    return df.where((F.col(status) == "ok") & (F.col(n) > 0))


def filled_choices(choices: Column) -> Column:
    """The choices (map of letter to text) that are not empty."""
    return F.map_filter(choices, lambda _, v: v.isNotNull() & (v != ""))


def of_duration(df: DataFrame, duration: str, wanted: str | None) -> DataFrame:
    return df.where(F.col(duration) == wanted) if wanted else df


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order: a question set of stated size."""
    return df.orderBy(order).limit(n)


def prefilled(parts: DataFrame, have: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parts whose key another table has, and the rest."""
    keys = have.select(key).distinct()
    return parts.join(keys, key, "left_semi"), parts.join(keys, key, "left_anti")
