"""Near-duplicate clusters by 32-bit MinHash bands and connected components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import graph
from chronoloom.operators.lineage import cut

# Hash ranges, seed and word separator of the signatures.
MAX_HASH, PRIME, SEED = 2**32 - 1, 2**61 - 1, 42
SEPARATOR = re.compile("[^A-Za-z_0-9]")


@cache
def band_choice(threshold: float, perms: int) -> tuple[int, int]:
    """(bands, rows) with the least mean of false-positive and false-negative area; the first of equals."""
    x, w = np.polynomial.legendre.leggauss(64)

    def area(lo: float, hi: float, b: int, r: int, hit: bool) -> float:
        s = lo + (hi - lo) * (x + 1) / 2
        miss = (1 - s**r) ** b
        return float(((1 - miss if hit else miss) * w).sum() * (hi - lo) / 2)

    grid = [(b, r) for b in range(1, perms + 1) for r in range(1, perms // b + 1)]
    return min(grid, key=lambda g: area(0, threshold, *g, True) + area(threshold, 1, *g, False))


@cache
def permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(SEED)
    pairs = [(draw.randint(1, PRIME, dtype=np.uint64), draw.randint(0, PRIME, dtype=np.uint64)) for _ in range(perms)]
    return np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.uint64)


def signature(text: str | None, perms: int = 256, words: int = 5, least: int = 5, chunk: int = 64) -> np.ndarray:
    """perms minima over the text's distinct word n-grams, in wrapping 64-bit arithmetic; all MAX_HASH under `least` words."""
    w = SEPARATOR.split(text or "")
    out = np.full(perms, MAX_HASH, dtype=np.uint32)
    if len(w) < least:
        return out.astype(np.uint64)
    (a, b), sha1 = permutations(perms), hashlib.sha1
    grams = set(map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else set()
    h = np.frombuffer(b"".join([sha1(g.encode()).digest()[:4] for g in grams]), dtype="<u4").astype(np.uint64)
    for i in range(0, len(h), chunk):  # a chunk's numbers stay in the cache
        x = np.multiply.outer(h[i : i + chunk], a)
        x += b
        high = x >> np.uint64(61)
        x &= np.uint64(PRIME)
        x += high  # the remainder by 2^61 - 1, or the divisor too much; less the divisor the low 32 bits are one more
        low = x.astype(np.uint32)
        low += x >= PRIME
        np.minimum(out, low.min(axis=0), out=out)
    return out.astype(np.uint64)


def bands(docs: DataFrame, key: str, text: str, threshold: float, perms: int = 256) -> DataFrame:
    """key, band, hash (bytes).  Texts without an n-gram share their whole signature, so one band stands for it."""
    b, r = band_choice(threshold, perms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            s = np.stack([signature(x, perms) for x in t.column(1).to_pylist()]).astype("<u4")
            n = np.where((s == MAX_HASH).all(axis=1), 1, b)
            row = np.repeat(np.arange(len(n)), n)
            band = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            raw = s[:, : b * r].reshape(-1, r)[row * b + band]
            hashes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * r), len(row), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(row)), pa.array(band.astype(np.int32)), hashes], [key, "band", "hash"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, band int, hash binary")


def clusters(docs: DataFrame, key: str, text: str, threshold: float = 0.7, perms: int = 256) -> DataFrame:
    """key, cluster (its smallest key): documents that share a band, directly or through others.

    Each row of a bucket is tied to the bucket's smallest key, so a bucket of any size gives as many edges
    as it has rows.
    """
    x = cut(bands(docs, key, text, threshold, perms))
    low = x.groupBy("band", "hash").agg(F.min(key).alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = x.join(low, ["band", "hash"]).where(F.col(key) != F.col("low")).select(F.col(key).alias("src"), F.col("low").alias("dst")).distinct()
    c = graph.components(edges).select(F.col("node").alias(key), F.col("root").alias("cluster"))
    return docs.select(key).join(c, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def keep_roots(docs: DataFrame, key: str, text: str, threshold: float = 0.7, perms: int = 256) -> DataFrame:
    """docs without the near duplicates of an earlier row."""
    roots = clusters(docs, key, text, threshold, perms).where(F.col(key) == F.col("cluster")).select(key)
    return docs.join(roots, key, "left_semi")
