"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.plans import consolidation, evaluation, media, memory, reports, sequences, vectors

MODULES = (memory, sequences, vectors, evaluation, consolidation, media, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
