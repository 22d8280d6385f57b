"""Elapsed-time nodes and the fact store over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators import facts


def elapsed_nodes(stream: DataFrame, by: str, start: str, end: str, tie: str, period: float) -> DataFrame:
    """stream with node and late: as the batch operator numbers them, with one small state for each value of by.

    Rows are ordered inside a micro-batch.  One that starts before a row of an earlier micro-batch is late:
    it has no node, and the caller may route it to a side table.
    """
    schema = T.StructType([*stream.schema, T.StructField("node", T.LongType()), T.StructField("late", T.BooleanType())])

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, first, newest = state.get if state.exists else (-1, float("-inf"), float("-inf"))
        p = pd.concat(list(frames)).sort_values([start, tie], kind="stable")  # one key's share of a micro-batch
        out, limit = [], newest
        for a, b in zip(p[start].tolist(), p[end].tolist(), strict=True):
            if a < limit:
                out.append(None)
                continue
            if node < 0 or b - first > period:
                node, first = node + 1, a
            newest = max(newest, a)
            out.append(node)
        state.update((node, first, newest))
        yield p.assign(node=pd.array(out, dtype="Int64"), late=[x is None for x in out])

    return stream.groupBy(by).applyInPandasWithState(run, schema, "node long, first double, newest double", "append", GroupStateTimeout.NoTimeout)


def fold_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on triples (s, p, o, node): each micro-batch's facts go to a folder of its own, so a replay overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        facts.fold_facts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Folders of micro-batches up to a number as one, batch=-1-upto; the old ones go when it is whole.

    For foreachBatch after some batches: a replayed batch above the number is not touched, and rows are
    counted once because readers skip folders that a compacted one covers.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = _numbers(fs, p)
    covered = [n for n in numbers if n <= upto]
    if not covered:
        return
    facts.combine(spark.read.parquet(*(f"{path}/batch={n}" for n in _live(numbers) if n <= upto))).write.mode("overwrite").parquet(f"{path}/batch={-1 - upto}")
    for n in covered:
        if n != -1 - upto:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}"), True)


def _numbers(fs, p) -> list[int]:
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and fs.exists(s.getPath().suffix("/_SUCCESS")))


def _live(numbers: list[int]) -> list[int]:
    """The folders that count: the widest compacted one, and batches after it."""
    done = max((-1 - n for n in numbers if n < 0), default=-1)
    return [n for n in numbers if n > done or n == -1 - done < 0]


def route_late(on_time: str, late: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on elapsed_nodes: rows with a node to one table, late ones to a side table; a replay overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        for path, rows in ((on_time, batch.where("not late").drop("late")), (late, batch.where("late").drop("late", "node"))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def stored_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all micro-batches so far, one row each."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    live = _live(_numbers(p.getFileSystem(spark._jsc.hadoopConfiguration()), p))
    return facts.combine(spark.read.parquet(*(f"{path}/batch={n}" for n in live)))


def advance(source: DataFrame, index: DataFrame, until: str, time: str = "node") -> DataFrame:
    """Rows of source that an index which only moves forward still lacks as of until: later than all it holds.  None if it is ahead."""
    held = F.broadcast(index.agg(F.max(time).alias("_held")))  # one row
    return source.crossJoin(held).where((F.col(time) <= until) & (F.col("_held").isNull() | (F.col(time) > F.col("_held")))).drop("_held")
