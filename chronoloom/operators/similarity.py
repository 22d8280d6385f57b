"""Exact similarity joins of vectors, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.vectors import cosine, dot

#: Numbers in the queries and in the rows of a cell, in a block of scores, and the least number of cells.
QUERIES, ROWS, SCORES, CELLS = 1 << 21, 1 << 23, 1 << 22, 16


def matrix(col: pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """Vectors of one length as rows, in double precision, scaled to length 1 if unit."""
    sizes = pc.unique(pc.list_value_length(col))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.to_pylist()}")
    m = np.asarray(pc.list_flatten(col).to_numpy(), dtype=float).reshape(len(col), sizes[0].as_py() if len(sizes) else 0)
    if unit:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n == 0, 1.0, n)
    return m


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids are; a null equals nothing."""
    c = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode().indices
    c = pc.fill_null(c, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = c[: len(a)], c[len(a) :].copy()
    y[y < 0] = -2
    return x, y


def _grid(nq: int, nr: int, width: int, top: int | None) -> tuple[int, int]:
    """Parts of the queries and of the rows: cells of bounded size, and enough of them, at the least copying."""
    a, b = max(1, -(-nq * width // QUERIES)), max(1, -(-nr * width // ROWS))
    while a * b < CELLS:
        # one more copy of all rows, or of all queries and what they send on
        a, b = (2 * a, b) if nr * a <= nq * b * (1 + (top or 0) / 10) else (a, 2 * b)
    return a, b


def matches(queries: DataFrame, rows: DataFrame, key: str, vec: str, least: float | None = None, top: int | None = None, unit: bool = True) -> DataFrame:
    """src (of queries), dst (of rows), score: cosine (dot product if not unit), other ids only.

    least keeps scores from that value on, top the best of each src, ties to the smaller dst.  Parts of the
    queries meet parts of the rows in the cells of a grid, one task each; a cell multiplies block by block, and
    only what the bounds let through leaves it (with top: at most that many a query and cell, and ties).  A
    vector moves once for each part of the other side; parts hold tens of thousands of vectors, so a table
    below that size is copied a fixed number of times.  All pairs are compared, so the work is the product of
    the sides; give a stated query set where both are large.
    """
    (nq, width), (nr, _) = (d.where(F.col(vec).isNotNull()).agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(1))).first() for d in (queries, rows))
    a, b = _grid(nq, nr, max(1, width), top)
    kind = queries.schema[key].dataType.simpleString()

    def side(d: DataFrame, ask: bool) -> DataFrame:
        own, to = (a, b) if ask else (b, a)
        x = F.col(vec) if d.schema[vec].dataType.simpleString() in ("array<float>", "array<double>") else F.col(vec).cast("array<double>")
        # both sides move as they are stored if they are of one type
        x = x if queries.schema[vec].dataType == rows.schema[vec].dataType else x.cast("array<double>")
        d = d.where(F.col(vec).isNotNull()).select(F.col(key).cast(kind).alias("id"), x.alias("x"), F.lit(ask).alias("ask"), F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("to"))
        return d.select("id", "x", "ask", F.col("own" if ask else "to").alias("i"), F.col("to" if ask else "own").alias("j"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        q, r = t.filter(t["ask"]), t.filter(pc.invert(t["ask"]))
        if not q.num_rows or not r.num_rows:
            return
        x, y = matrix(q["x"], unit), matrix(r["x"], unit)
        (ca, cb), ids, others = _codes(q["id"], r["id"]), q["id"].combine_chunks(), r["id"].combine_chunks()
        del t, q, r
        order = np.argsort(cb, kind="stable")
        lo, hi = (np.searchsorted(cb[order], ca, s) for s in ("left", "right"))
        size = max(1, SCORES // len(y))
        for i in range(0, len(x), size):
            s = x[i : i + size] @ y.T
            ok = np.ones(s.shape, dtype=bool) if least is None else s >= least
            for k in np.flatnonzero(hi[i : i + size] > lo[i : i + size]):
                ok[k, order[lo[i + k] : hi[i + k]]] = False
            u, v = np.divmod(np.flatnonzero(ok), len(y))
            score = s[u, v]
            if top is not None:
                n = np.bincount(u, minlength=len(s))
                end, keep = np.cumsum(n), np.ones(len(u), dtype=bool)
                for k in np.flatnonzero(n > top):
                    c = score[end[k] - n[k] : end[k]]
                    keep[end[k] - n[k] : end[k]] = c >= np.partition(c, -top)[-top]  # ties stay and are settled at the end
                u, v, score = u[keep], v[keep], score[keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(u + i)), others.take(pa.array(v)), pa.array(score)], ["src", "dst", "score"])

    out = side(queries, True).unionByName(side(rows, False)).groupBy("i", "j").applyInArrow(cell, f"src {kind}, dst {kind}, score double")
    if top is not None:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("_k") <= top).drop("_k")
    return out


def synonym_edges(entities: DataFrame, key: str, text: str, vec: str, least: float = 0.8, nearest: int = 2047, most: int = 101) -> DataFrame:
    """src, dst, score of names with over 2 letters or digits: nearest neighbours from least on, at most `most` each."""
    long = entities.where(F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) > 2)
    return matches(long, entities, key, vec, least, min(nearest, most))


def late_interaction(a: Column, b: Column) -> Column:
    """For each vector of array a the best dot product with one of array b, summed."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def approximate(queries: DataFrame, rows: DataFrame, key: str, vec: str, top: int, tables: int = 16, bits: int = 8, seed: int = 7) -> DataFrame:
    """src, dst, score: the best rows by cosine among those that share a side of `bits` random planes in one of `tables` draws.

    Candidates meet in equi-joins on (table, side), so nothing compares all with all; recall is measured in
    the tests.  Planes come from the seed and the vectors' length, which the first row gives.
    """
    first = rows.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    size = first[0] if first else 1
    planes = np.random.default_rng(seed).normal(size=(size, tables * bits))
    kind = rows.schema[key].dataType.simpleString()

    def sides(frames):
        for f in frames:
            m = np.stack([np.asarray(x, dtype=float) for x in f["x"]]) @ planes > 0 if len(f) else np.zeros((0, tables * bits), dtype=bool)
            code = m.reshape(len(f), tables, bits) @ (1 << np.arange(bits))
            yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), tables), "x": np.repeat(f["x"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(f)), "side": code.ravel()})

    def coded(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("x")).mapInPandas(sides, f"id {kind}, x array<double>, t int, side long")

    q, r = coded(queries).select(F.col("id").alias("src"), F.col("x").alias("q"), "t", "side"), coded(rows).select(F.col("id").alias("dst"), "x", "t", "side")
    scored = q.join(r, ["t", "side"]).where("src <> dst").select("src", "dst", cosine(F.col("q"), F.col("x")).alias("score")).dropDuplicates(["src", "dst"])
    return scored.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("_k") <= top).drop("_k")
