"""Concatenate and cut: tokenised documents in a row, cut into windows of a fixed number of ids.

Pass one tokenises each partition and notes, beside each document's ids, how many ids stand before it
in its partition; the table goes to the shared folder.  The totals of the partitions (one row each)
are summed up to global offsets.  Pass two cuts every document where a window ends.  Windows are full
but for the last, and every piece says where it begins in its document and in its window.

doc_id is returned as bigint.  A null text counts as empty and gives the end id alone.  Repeated rows are packed one by one.  An
empty table gives no pieces.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import blocks, kept, materialize, ragged, rows_of, single_threaded, strings

LENGTH = 2048
END = 1
COLUMNS = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _encoder(path: str) -> Pieces:
    """Pieces by the tokenizers library; one for each worker process."""

    def make() -> Pieces:
        single_threaded()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        vocab = t.get_vocab(with_added_tokens=True)
        size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        size[list(vocab.values())] = list(map(len, vocab))  # a byte-level token has a character for each byte

        def encode(pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
            """Plain pieces go through the library end to end, and their ids are dealt out by byte lengths."""
            some, rest = np.flatnonzero(plain), np.flatnonzero(~np.array(plain, dtype=bool))
            parts, counts = [], []
            for a in range(0, len(some), 500):
                text = "".join([pieces[i] for i in some[a : a + 500].tolist()])
                ids = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                at = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) == 32)  # a plain piece's only space
                parts.append(ids)
                counts.append(np.diff(np.append(np.searchsorted(np.cumsum(size[ids]) - size[ids], at), len(ids))))
            odd = [e.ids for e in t.encode_batch_fast([pieces[i] for i in rest.tolist()], add_special_tokens=False)]
            parts.append(np.fromiter(chain.from_iterable(odd), dtype=np.uint32))
            counts.append(np.fromiter(map(len, odd), dtype=np.int64, count=len(odd)))
            n, ids = np.concatenate(counts), np.concatenate(parts)
            place = np.argsort(np.r_[some, rest])
            return ids[ragged((np.cumsum(n) - n)[place], n[place])], n[place]

        return Pieces(encode)

    return kept(("packing", path), make)


def tokenise(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, part, before (ids before it in the partition), n, ids (little-endian, n numbers of 16 or 32 bits, with end)."""

    def run(batches):
        enc, part, before = _encoder(path), TaskContext.get().partitionId(), 0
        for rb in blocks(batches, keep=True):
            ids, n = enc(strings(rb.column("text")))
            stop = np.cumsum(n)
            kind = "<u2" if not len(ids) or max(ids.max(), end) < 1 << 16 else "<u4"
            small, last = ids.astype(kind), np.array([end], dtype=kind).tobytes()
            rows = [small[a:b].tobytes() + last for a, b in zip((stop - n).tolist(), stop.tolist(), strict=True)]
            n = n + 1
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(first), pa.array(n), pa.array(rows, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    return rows_of(docs).mapInArrow(run, "doc_id bigint, part int, before bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of COLUMNS; ids as little-endian unsigned 32-bit."""
    table = materialize(tokenise(docs, path, end), "packing")
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each partition of the input: a window over them, and their broadcast, stay small at any size
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def cut(batches):
        for rb in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, at, n, raw in zip(*(rb.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                i = 0
                if len(raw) < 4 * n:
                    raw = np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                while i < n:
                    g = at + i
                    m = min(n - i, length - g % length)
                    for c, v in zip(cols, (doc, i, m, raw[4 * i : 4 * (i + m)], n, g // length, g % length), strict=True):
                        c.append(v)
                    i += m
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return table.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids").mapInArrow(cut, COLUMNS)
