"""Order-dependent operators: gaps, robust scores, cuts, chunks, nodes and carried labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gap_segments(df: DataFrame, by: str, time: str, tie: str, gap: float) -> DataFrame:
    """segment: counts up within by wherever the time since the row before exceeds gap."""
    w = Window.partitionBy(by).orderBy(time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def stitched(frames: DataFrame, by: str, time: str, tie: str, gap: float) -> DataFrame:
    """frames with gap (null on the first of by): of equal times the first by tie stays; gap says that the time since the row before exceeds the bound."""
    one = frames.withColumn("_k", F.row_number().over(Window.partitionBy(by, time).orderBy(tie))).where("_k = 1").drop("_k")
    return one.withColumn("gap", F.col(time) - F.lag(time).over(Window.partitionBy(by).orderBy(time)) > gap)


def file_grid(entries: DataFrame, by: str, file: str, start: str, files: int) -> DataFrame:
    """entries with chunk: files in order of their least start (then name), so many to a chunk; overlapping files stay whole."""
    f = entries.groupBy(by, file).agg(F.min(start).alias("_s"))
    f = f.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("_s", file)) - 1) / files).cast("bigint"))  # one row a file
    return entries.join(f.select(by, file, "chunk"), [by, file])


def robust_z(df: DataFrame, by: str, order: list[str], x: str, half: int) -> DataFrame:
    """z: (x - median) / max(1.4826 MAD, floor) over half rows before and after, from 3 values on.

    floor is a twentieth of the whole median, at least 1e-6.
    """
    w = Window.partitionBy(by).orderBy(*order)
    f = w.rowsBetween(-half, half)
    base = df.join(df.groupBy(by).agg(F.greatest(F.percentile(x, F.lit(0.5)) * 0.05, F.lit(1e-6)).alias("_floor")), by)
    base = base.withColumn("_m", F.percentile(x, F.lit(0.5)).over(f)).withColumn("_v", F.collect_list(x).over(f))
    d = F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("_m"))))
    n = F.size("_v")
    mad = (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2
    return base.withColumn("z", F.when(n >= 3, (F.col(x) - F.col("_m")) / F.greatest(mad * 1.4826, F.col("_floor")))).drop("_floor", "_m", "_v")


def cut(t: np.ndarray, z: np.ndarray, d: np.ndarray, gaps: np.ndarray, threshold: float, least: float, shortest: float, longest: float) -> list[tuple[float, str]]:
    """Cuts of one ordered timeline with their origin: gaps, then candidates by z (earlier first of ties), then splits.

    A candidate counts if z and distance exceed their bounds and it keeps shortest from the ends and from
    every cut so far.  A stretch over longest is split at its largest z inside the allowed range, else at
    the bound itself.
    """
    if not len(t):
        return []
    cuts: list[tuple[float, str]] = [(float(x), "gap") for x in t[gaps]]
    ends = [float(t[0]), float(t[-1])]
    for i in np.lexsort((t, -z)):
        if z[i] > threshold and d[i] > least and all(abs(t[i] - e) >= shortest for e in ends) and all(abs(t[i] - c) >= shortest for c, _ in cuts):
            cuts.append((float(t[i]), "detected"))
    out, last = [], ends[0]
    for c, origin in [*sorted(cuts), (ends[1], "end")]:
        while c - last > longest:
            lo, hi = last + shortest, min(last + longest, c - shortest)
            inside = np.flatnonzero((t >= lo) & (t <= hi))
            at = float(t[inside[np.argmax(z[inside])]]) if len(inside) else last + longest
            out.append((at, "cap"))
            last = at
        if origin != "end":
            out.append((c, origin))
            last = c
    return out


def boundary_cuts(df: DataFrame, by: str, threshold: float, least: float, shortest: float, longest: float) -> DataFrame:
    """Cuts of every timeline of df (by, t, z, d, gap); greedy, so each timeline is one group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t", kind="stable")
        got = cut(p["t"].to_numpy(float), p["z"].fillna(-np.inf).to_numpy(float), p["d"].fillna(0).to_numpy(float), p["gap"].fillna(False).to_numpy(bool), threshold, least, shortest, longest)
        return pd.DataFrame({by: [p[by].iloc[0]] * len(got), "t": [c for c, _ in got], "origin": [o for _, o in got]})

    return df.select(by, "t", "z", "d", "gap").groupBy(by).applyInPandas(run, f"{by} bigint, t double, origin string")


def elapsed_nodes(df: DataFrame, by: list[str], start: str, end: str, tie: str, period: float) -> DataFrame:
    """node: counts up within by when a row's end lies more than period after the node's first start."""
    schema = T.StructType([*df.schema, T.StructField("node", T.LongType())])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([start, tie], kind="stable")
        node, first, out = -1, None, []
        for a, b in zip(p[start].tolist(), p[end].tolist(), strict=True):
            if first is None or b - first > period:
                node, first = node + 1, a
            out.append(node)
        return p.assign(node=out)

    return df.groupBy(*by).applyInPandas(run, schema)


def carry_forward(df: DataFrame, by: str, order: str, labels: Column, limit: int) -> DataFrame:
    """carried: the row's own single label, else the latest within limit rows; a row of several labels ends the carry."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_l", labels).withColumn("_i", F.row_number().over(w))
    mark = F.when(F.size("_l") >= 1, F.struct(F.when(F.size("_l") == 1, F.col("_l")[0]).alias("label"), F.col("_i").alias("at")))
    d = d.withColumn("_last", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("carried", F.when(F.col("_i") - F.col("_last")["at"] <= limit, F.col("_last")["label"])).drop("_l", "_i", "_last")


def count_groups(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """part: n rows after one another share a number, within by."""
    return df.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / n).cast("bigint"))


def anchored_windows(df: DataFrame, by: str, start: str, width: float) -> DataFrame:
    """window_start: the first window of each by begins at its first row, later ones at multiples of width.

    A row belongs to the first window if it starts inside it; every other row's window is its own multiple,
    so one minimum a group decides it and windows may overlap the first.
    """
    first = df.groupBy(by).agg(F.min(start).alias("_t0"))
    inside = F.col(start) < F.col("_t0") + width
    return df.join(first, by).withColumn("window_start", F.when(inside, F.col("_t0")).otherwise(F.floor(F.col(start) / width) * width).cast("double")).drop("_t0")


def segments(cuts: DataFrame, by: str, time: str, ends: DataFrame, start: str, end: str) -> DataFrame:
    """by, start, end: half-open stretches between the cuts of each timeline; ends has one row a timeline."""
    t = cuts.select(by, F.col(time).alias("_t")).unionByName(ends.select(by, F.col(start).alias("_t"))).unionByName(ends.select(by, F.col(end).alias("_t"))).distinct()
    return t.withColumn("_e", F.lead("_t").over(Window.partitionBy(by).orderBy("_t"))).where("_e is not null").select(by, F.col("_t").alias("start"), F.col("_e").alias("end"))
