"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches and are worked on as byte arrays: `text_block` lays the texts of
a block end to end with one line feed around each, `Spans` finds words, and `Roll` hashes any byte
range in constant time from prefix sums.  Where keys are exchanged, many of them travel in one
packed binary row per target bucket (`packed`), so the shuffle moves bytes instead of rows.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: little memory to write and to read
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    p, fs = _path(df.sparkSession, df._written)
    fs.delete(p, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def refit(col: pa.Array, kind: pa.DataType) -> pa.Array:
    """Numbers of characters in the type that the column came in."""
    return col.cast(kind) if pa.types.is_integer(kind) or pa.types.is_floating(kind) else col.cast(pa.string()).cast(kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange: several for each partition, so that hashing them evens out."""
    return max(256, 2 * shuffle_partitions(spark))


def crc_order(col: str):
    """A fixed pseudo-random order of rows, by which bounded training samples are drawn."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (as bigint, cast once), text, and more columns."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most per_class whole texts of each label value 0 and 1, none over max_bytes bytes; their labels; and all labelled ids of both classes, counted.

    Rows of labels that repeat a doc_id count once, with the largest value; nulls are left out.  The
    ids are bounded by 2 * per_class rows, which makes their broadcast safe at any input size.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    parts = [one.where(F.col("_y") == y).orderBy(crc_order("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    got = (
        rows_of(docs)
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(ids), "doc_id")
        .orderBy(crc_order("doc_id"), "doc_id", F.xxhash64("text"))
        .limit(2 * per_class)
        .toArrow()
    )
    total = np.zeros(2)
    for r in one.where("_y in (0, 1)").groupBy("_y").count().collect():  # two rows
        total[r["_y"]] = r["count"]
    return got.column("text").to_pylist(), np.array(got.column("_y").to_pylist(), dtype=np.int64), total


def class_weights(y: np.ndarray, sampled: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """Weights of the items y that give both classes their shares among all labelled ids; sampled: labels of the whole sample."""
    if total is None:
        return np.ones(len(y))
    w = total / np.maximum(np.bincount(sampled, minlength=2), 1)
    w = w[y]
    return w * len(y) / max(w.sum(), 1e-12)


# ---- Arrow batches -------------------------------------------------------------------------------


#: What a worker process keeps from task to task: the state of the operator that ran last, and of no other.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """The worker's state under key, made if another operator ran last."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what an operator with state has left in this worker."""
    _KEPT.clear()


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about max_bytes of text; a longer text makes a slice of its own.  keep: the operator has state in kept()."""
    if not keep:
        forget()
    for b in batches:
        if not b.num_rows:
            continue
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + max_bytes, "right")))
            yield b.slice(i, j - i)
            i = j
        tidy()


def strings(col: pa.Array) -> list[str]:
    return pc.fill_null(col, "").to_pylist()


def text_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, end): texts end to end, each between line feeds; text i is bytes[first[i]:end[i]]."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end = np.cumsum(n + 1)
    return buf, end - n, end


def raw_bytes(col: pa.Array) -> list[bytes]:
    return pc.fill_null(col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col, b"").to_pylist()


# ---- bytes and hashes ----------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Roll:
    """Rolling polynomial hashes over random 64-bit values of bytes, modulo 2^64."""

    table = np.random.default_rng(20240611).integers(1, 2**64 - 1, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    _pow = np.ones(1, dtype=np.uint64)
    _inv = np.ones(1, dtype=np.uint64)

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            n = max(n, 2 * len(cls._pow), 1 << 16)
            for name, b in (("_pow", cls.base), ("_inv", pow(cls.base, -1, 2**64))):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls._pow, cls._inv

    def __init__(self, buf: np.ndarray):
        p, self.inv = self._tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.table[buf] * p[: len(buf)], out=self.sums[1:])

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of bytes[first:end], the same wherever the bytes stand."""
        h = (self.sums[end] - self.sums[first]) * self.inv[first]
        return mix(h + (end - first).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of one size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.inv[:n])


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(chars, dtype=np.uint8)] = True
    return t


WHITE = table_of(b" \t\n\x0b\x0c\r")
#: Bytes that part tokens for the tagging models: ASCII other than letters and digits.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])


class Spans:
    """Maximal runs of bytes outside sep, and the text each stands in.  The block starts and ends in sep."""

    def __init__(self, buf: np.ndarray, first: np.ndarray, end: np.ndarray, sep: np.ndarray):
        d = np.diff(sep[buf].view(np.int8))
        self.s = np.flatnonzero(d == -1) + 1
        self.e = np.flatnonzero(d == 1) + 1
        self._bounds(first)

    def _bounds(self, first: np.ndarray) -> None:
        at = np.searchsorted(self.s, first)
        self.at = np.append(at, len(self.s))  # runs at[i]:at[i+1] belong to text i
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(first)), self.count)

    def keep(self, mask: np.ndarray, first: np.ndarray) -> None:
        self.s, self.e = self.s[mask], self.e[mask]
        self._bounds(first)


def seg_sum(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of x[s:e]; s and e ascend.  Each sum depends on its own segment alone."""
    if not len(s):
        return np.zeros((0, *x.shape[1:]), dtype=x.dtype)
    x = np.concatenate([x, np.zeros((1, *x.shape[1:]), dtype=x.dtype)])
    out = np.add.reduceat(x, np.minimum(np.stack([s, np.maximum(s, e)], 1).ravel(), len(x) - 1))[::2].copy()
    out[s >= e] = 0
    return out


def seg_counts(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of true values in x[s:e]."""
    c = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=c[1:])
    return c[e] - c[s]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... counts[i] of them, for each i in turn."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


# ---- packed exchanges ----------------------------------------------------------------------------


def packed(key: np.ndarray, n: int, /, **columns: np.ndarray) -> pa.RecordBatch | None:
    """One row for each bucket (the key's high bits, scaled to n), its columns as binary arrays."""
    if not len(key):
        return None
    b = ((key >> U64(32)) * U64(n)) >> U64(32)
    order = np.argsort(b, kind="stable")
    b = b[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    end = np.r_[at[1:], len(b)]
    out = {"bucket": pa.array(b[at].astype(np.int32))}
    for name, x in columns.items():
        x = np.ascontiguousarray(x[order])
        raw, w = memoryview(x.view(np.uint8).reshape(-1)), x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
        out[name] = pa.array([bytes(raw[i * w : j * w]) for i, j in zip(at.tolist(), end.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def joined(col: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays of a column end to end, and how many items each row gave."""
    rows = col.to_pylist()
    w = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(rows), dtype=dtype), np.array([len(r) // w for r in rows], dtype=np.int64)


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; its peak then follows one block, not the sum of many."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def single_threaded() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
