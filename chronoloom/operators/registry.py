"""Parts chosen by name: chunking strategies, aggregates of metrics, models and loaders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import sequences


class Named(dict):
    """Functions under names; a name that is not there is an error that lists those that are."""

    def add(self, name: str) -> Callable:
        def put(f: Callable) -> Callable:
            if name in self:
                raise ValueError(f"{name} is taken")
            self[name] = f
            return f

        return put

    def __missing__(self, name: str):
        raise KeyError(f"{name!r} is none of {', '.join(sorted(self))}")


CHUNKING, AGGREGATES, MODELS, LOADERS = Named(), Named(), Named(), Named()


@CHUNKING.add("fixed")
def fixed(entries: DataFrame, window_seconds: float = 30.0, native_seconds: float = 30.0, by: str = "person", file: str = "file", start: str = "start") -> DataFrame:
    """entries with chunk: so many native files as the window holds, one at least."""
    return sequences.file_grid(entries, by, file, start, max(1, round(window_seconds / native_seconds)))


@CHUNKING.add("gap")
def gap(entries: DataFrame, tolerance: float = 60.0, by: str = "person", start: str = "start", tie: str = "file") -> DataFrame:
    """entries with chunk: a new one after every pause over the tolerance."""
    return sequences.gap_segments(entries, by, start, tie, tolerance).withColumnRenamed("segment", "chunk")


AGGREGATES.update(mean=F.avg, sum=F.sum, max=F.max, min=F.min, median=lambda c: F.percentile(c, F.lit(0.5)))


def aggregate(metrics: DataFrame, by: list[str], value: str, how: str) -> DataFrame:
    return metrics.groupBy(*by).agg(AGGREGATES[how](F.col(value)).alias(value))


@MODELS.add("echo")
def echo(**_) -> Callable[[list[str]], list[str]]:
    """Replies with the prompt: for tests and dry runs."""
    return lambda prompts: list(prompts)


@MODELS.add("constant")
def constant(reply: str = "", **_) -> Callable[[list[str]], list[str]]:
    return lambda prompts: [reply] * len(prompts)


def model(name: str, **options) -> Callable[[list[str]], list[str]]:
    return MODELS[name](**options)


@LOADERS.add("rows")
def rows(df: DataFrame, batch: int = 50, order: str | Column | None = None) -> Iterator[list]:
    """Rows in batches, streamed to the caller partition by partition."""
    out: list = []
    for r in (df.orderBy(order) if order is not None else df).toLocalIterator():
        out.append(r)
        if len(out) == batch:
            yield out
            out = []
    if out:
        yield out
