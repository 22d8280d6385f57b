"""Exact top-k by integer inner product over a bit-sliced index.

Every component becomes floor(scale * x).  An index block holds its rows sorted by vec_id as bitmaps:
slice j of attribute d has bit i set if bit j of row i's (shifted, so non-negative) value is.  A query
adds the slices of all attributes, once for each set bit of its own component and complemented where
that is negative, by carry-save bitmap adders.  The k best rows are read off the sum from its most
significant slice downward; rows tied at the boundary are resolved by vec_id, and the scores of the
chosen rows are computed exactly.  Blocks of rows meet blocks of queries in a grid of groups.

Vectors that are null or hold a null or non-finite component take no part, as queries or candidates.
Missing trailing components count as 0.  A query meets every row but its own: rows that repeat its vec_id
are candidates like others, and of rows that repeat vec_id and vector each is a query and a candidate of
its own.  vec_id is returned as bigint; null vec_ids are candidates but no queries, last in ties.  Tables
of any size, of equal vectors or of vectors without components give what they have; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64

#: Rows and queries of a group, and the least number of parts along each side.
ROWS, QUERIES, LEAST = 16_384, 2048, 8
COLUMNS = "query_id bigint, h bigint, times bigint, vec_id bigint, score bigint"


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of bigint) and times (equal rows) of the rows that take part."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return table.where(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).groupBy("vec_id", "x").agg(F.count("*").alias("times"))


def _add3(x: np.ndarray) -> np.ndarray:
    """Carry-save addition: (m, slices, words) numbers to two with the same sum, one slice wider."""
    while len(x) > 2:
        k = len(x) // 3
        a, b, c = x[: 3 * k : 3], x[1 : 3 * k : 3], x[2 : 3 * k : 3]
        half = a ^ b
        out = np.zeros((2 * k + len(x) - 3 * k, x.shape[1] + 1, x.shape[2]), dtype=np.uint64)
        out[:k, :-1] = half ^ c
        out[k : 2 * k, 1:] = (a & b) | (half & c)
        out[2 * k :, :-1] = x[3 * k :]
        x = out
    return x


def _ripple(x: np.ndarray) -> np.ndarray:
    """The sum of one or two sliced numbers."""
    if len(x) < 2:
        return x[0]
    a, b = x
    out, carry = np.zeros((len(a) + 1, a.shape[1]), dtype=np.uint64), np.zeros(a.shape[1], dtype=np.uint64)
    for i in range(len(a)):
        half = a[i] ^ b[i]
        out[i], carry = half ^ carry, (a[i] & b[i]) | (half & carry)
    out[-1] = carry
    return out


def _bits(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


class Index:
    """Slices of a block; x: rows by attributes, in order of vec_id."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.words = -(-n // 64)
        u = (x - x.min(0)).astype(np.uint64)
        self.width = max(1, int(u.max()).bit_length()) if u.size else 1
        u = np.concatenate([u, np.zeros((self.words * 64 - n, x.shape[1]), dtype=np.uint64)])
        bits = ((u[:, :, None] >> np.arange(self.width, dtype=np.uint64)) & U64(1)).astype(np.uint8)  # rows, attributes, slices
        one = np.ascontiguousarray(np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder="little")).view(np.uint64)
        self.slices = np.stack([one, ~one])  # as they are, and complemented
        self.all = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def sum(self, q: np.ndarray) -> np.ndarray:
        """Slices of the rows' scores, up to a constant."""
        neg, mag, terms = (q < 0).astype(np.int64), np.abs(q), []
        for b in range(int(mag.max()).bit_length() if len(q) else 0):
            d = np.flatnonzero((mag >> b) & 1)
            if len(d):
                terms.append((b, _add3(self.slices[neg[d], d])))
        if not terms:
            return np.zeros((1, self.words), dtype=np.uint64)
        width = max(b + t.shape[1] for b, t in terms)
        wide = np.zeros((sum(len(t) for _, t in terms), width, self.words), dtype=np.uint64)
        i = 0
        for b, t in terms:
            wide[i : i + len(t), b : b + t.shape[1]] = t
            i += len(t)
        return _ripple(_add3(wide))

    def top(self, q: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k best scores among the allowed, all if fewer."""
        sure, tied = np.zeros(self.words, dtype=np.uint64), allowed.copy()
        for s in self.sum(q)[::-1]:
            x = sure | (tied & s)
            n = int(np.bitwise_count(x).sum())
            if n > k:
                tied &= s
            else:
                sure = x
                tied &= ~s
                if n == k:
                    return _bits(sure)
        got = _bits(sure)
        return np.r_[got, _bits(tied)[: k - len(got)]]  # boundary rows: smallest vec_id first


def _matrix(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _cell(k: int):
    def run(t: pa.Table) -> pa.Table:
        vid, x, ask = t.column("vec_id").to_pylist(), t.column("x").to_pylist(), np.array(t.column("ask").to_pylist(), dtype=bool)
        times, h = t.column("times").to_numpy(), t.column("h").to_numpy()
        m = _matrix(x, max([len(r) for r in x], default=0))
        last = np.array([v is None for v in vid])
        ids = np.array([v or 0 for v in vid], dtype=np.int64)
        base = np.flatnonzero(~ask)
        base = np.repeat(base, np.minimum(times[base], k + 1))  # of equal rows, more can't be among the best
        base = base[np.lexsort((h[base], ids[base], last[base]))]
        out: list[list] = [[] for _ in range(5)]
        if len(base) and ask.any():
            index = Index(m[base])
            bid, none, bh = ids[base], last[base], h[base]
            for i in np.flatnonzero(ask):
                allowed = index.all
                own = np.flatnonzero((bid == ids[i]) & ~none & (bh == h[i]))[:1]
                if len(own):  # one row of its own does not count
                    allowed = allowed.copy()
                    allowed[own // 64] &= ~(U64(1) << (own % 64).astype(np.uint64))
                rows = index.top(m[i], allowed, k)
                for c, v in zip(out, ([int(ids[i])] * len(rows), [int(h[i])] * len(rows), [int(times[i])] * len(rows), [None if none[r] else int(bid[r]) for r in rows], (index.x[rows] @ m[i]).tolist()), strict=True):
                    c.extend(v)
        return pa.table({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(COLUMNS.split(", "), out, strict=True)})

    return run


def search(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows, ties to the smaller vec_id."""
    q = quantised(table, scale).withColumn("h", F.xxhash64("vec_id", "x"))
    n = q.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    down, across = max(LEAST, -(-n["n"] // ROWS)), max(LEAST, -(-n["q"] // QUERIES))
    to = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    rows = q.select("vec_id", "x", "times", "h", F.lit(False).alias("ask"), F.pmod("h", F.lit(down)).alias("a"), to(across).alias("b"))
    asks = q.where(is_query).select("vec_id", "x", "times", "h", F.lit(True).alias("ask"), to(down).alias("a"), F.pmod("h", F.lit(across)).alias("b"))
    best = rows.unionByName(asks).groupBy("a", "b").applyInArrow(_cell(k), COLUMNS)
    w = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("n")).drop("n")
