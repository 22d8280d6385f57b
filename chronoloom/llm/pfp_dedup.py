"""Removal of repeated 100-byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases.  The trigger of a 100-byte string is its 48-byte
substring of least rolling hash, leftmost of ties; strings that follow one another and share their
trigger form a phrase, so neighbouring phrases overlap by 99 bytes and every 100-byte string lies in
exactly one phrase, fixed by its own bytes.  Equal strings therefore sit in phrases of equal trigger,
at the same distance from it, and no comparison ever runs past a phrase: the order of the parse's
suffixes that a comparison needs is one phrase deep.

The parse (phrases in corpus order) settles most strings: texts are held in blocks of ascending doc_id,
each block sends every trigger once, and a phrase that is a block's only one of its trigger keeps its
first such occurrence only.  Triggers with several different phrases go to the dictionary, with the first
occurrences of those.  Their phrases are cut once more, by the distance of strings from the trigger, into pieces of at most STRETCH strings; the
bytes that a piece's strings share say where it goes, so a trigger common to a great share of all texts
spreads over the buckets.  There the suffixes of the dictionary's pieces, sorted by their first 100 bytes
with prefix doubling (of pieces that share a fingerprint with others), put equal strings side by side,
where corpus order says which is first.  Phrases and pieces are named by 64-bit rolling hashes, as
dictionaries of this kind are; strings of different pieces are told apart by their bytes, which travel
compressed.

doc_id counts as bigint.  A null text counts as empty.  Rows that repeat a doc_id are ordered by a hash
of their text, so an equal text later in that order is removed; null doc_ids come last.  Texts under 100
bytes lose nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Roll, buckets, forget, joined, mix, packed, ragged, raw_bytes, refit, text_block, tidy

SIZE, TRIGGER = 100, 48
#: Strings of a piece.
STRETCH = 9
#: Bytes of text of a block, and ranges of doc_id that are weighed to make blocks; bytes hashed at a time.
BLOCK, RANGES, CHUNK = 4 << 20, 4096, 1 << 18
LAST = 2**63 - 1
PARSE = "bucket int, q int, trigger binary, phrase binary"
REPLY = "q int, trigger binary, kind binary"
WORK = "kind int, bucket int, q int, a binary, b binary"
CUTS = "q int, cuts binary"


# ---- phrases -------------------------------------------------------------------------------------


class Runs:
    """Phrases of the texts of a block, in corpus order: text, strings first..last, hashes of trigger and phrase, the trigger's place."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        parts, i = [], 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                n += len(texts[j])
                j += 1
            parts.append(self._of(texts[i:j], i))
            i = j
        self.row, self.first, self.last, self.trigger, self.phrase, self.at = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in range(6))

    @staticmethod
    def _of(texts: list[bytes], base: int) -> tuple:
        buf, first, end = text_block(texts)
        count = np.maximum(end - first - SIZE + 1, 0)
        if not count.sum():
            e = np.zeros(0, dtype=np.int64)
            return e, e, e, e.astype(np.uint64), e.astype(np.uint64), e
        roll = Roll(buf)
        h = roll.windows(TRIGGER)
        m = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span, want = 1, SIZE - TRIGGER + 1
        while span * 2 <= want:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if want > span:
            m = np.minimum(m[: len(m) - (want - span)], m[want - span :])
        p = ragged(first, count)
        at = (m[p] & U64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        stop = np.r_[new[1:], len(p)] - 1
        a, b, doc = p[new], p[stop], doc[new]
        return doc + base, a - first[doc], b - first[doc], h[at[new]], roll.span(a, b + SIZE), at[new] - first[doc]

    def bytes_of(self, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
        """The bytes of strings first..last of texts, end to end."""
        return b"".join(self.texts[i][x : y + SIZE] for i, x, y in zip(row.tolist(), first.tolist(), last.tolist(), strict=True))

    def pieces(self, on: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of the phrases on: row, first and last string, hash of the bytes that all strings at these distances share, hash of the piece."""
        row, first, last, at = self.row[on], self.first[on], self.last[on], self.at[on]
        low, high = (at - last) // STRETCH, (at - first) // STRETCH  # distances fall as strings advance
        count = high - low + 1
        j = ragged(low, count)
        row, first, last, at = (np.repeat(x, count) for x in (row, first, last, at))
        share = at - STRETCH * j
        first, last = np.maximum(first, share - STRETCH + 1), np.minimum(last, share)
        key, whole = np.zeros(len(row), dtype=np.uint64), np.zeros(len(row), dtype=np.uint64)
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            roll = Roll(np.frombuffer(self.texts[row[a]], dtype=np.uint8))
            key[a:b] = roll.span(share[a:b], share[a:b] + SIZE - STRETCH + 1)
            whole[a:b] = roll.span(first[a:b], last[a:b] + SIZE)
        return row, first, last, key, whole


def _spread(trigger: np.ndarray) -> np.ndarray:
    """Triggers are least hashes and so crowd at small values; these do not."""
    return mix(trigger * U64(0x9E3779B97F4A7C15))


def _firsts(key: np.ndarray) -> np.ndarray:
    """True where an item is the first with its key."""
    out = np.zeros(len(key), dtype=bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def _cuts(row: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cut records: text, first byte, end."""
    return np.stack([row, start, last + SIZE], 1).astype("<i4")


def _texts(t: pa.Table) -> tuple[pa.StructArray, list[bytes]]:
    """The block's rows in corpus order, and their texts."""
    forget()
    tidy()  # what the block before has left
    rows = t.sort_by([("key", "ascending"), ("hash", "ascending")]).column("row")
    rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    return rows, raw_bytes(rows.field(rows.type.get_field_index("text")))


# ---- parse ---------------------------------------------------------------------------------------


def _parse(n: int):
    def run(t: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.nulls(0, pa.int32()), "q": pa.nulls(0, pa.int32()), "trigger": pa.nulls(0, pa.binary()), "phrase": pa.nulls(0, pa.binary())})
        q = t.column("q")[0].as_py()
        r = Runs(_texts(t)[1])
        if not len(r.row):
            return empty
        order = np.lexsort((r.phrase, r.trigger))
        g, p = r.trigger[order], r.phrase[order]
        new = np.r_[True, g[1:] != g[:-1]]
        kinds = np.add.reduceat((new | np.r_[True, p[1:] != p[:-1]]).astype(np.uint64), np.flatnonzero(new))
        value = np.where(kinds == 1, p[new] | U64(1), U64(0))  # the only phrase, or 0
        b = packed(_spread(g[new]), n, trigger=g[new], phrase=value)
        return pa.table({"bucket": b.column(0), "q": pa.array([q] * b.num_rows, pa.int32()), "trigger": b.column(1), "phrase": b.column(2)})

    return run


def _by_block(q: np.ndarray, **columns: np.ndarray) -> tuple[list[int], dict[str, list[bytes]]]:
    order = np.argsort(q, kind="stable")
    s = q[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=np.int64)
    end = np.r_[at[1:], len(s)] if len(s) else at
    return s[at].tolist(), {k: [np.ascontiguousarray(x[order[a:b]]).tobytes() for a, b in zip(at, end, strict=True)] for k, x in columns.items()}


def _reply(t: pa.Table) -> pa.Table:
    """What each block must know of its triggers.  1: its phrase stands in an earlier block; 2: other blocks have other phrases."""
    trigger, n = joined(t.column("trigger"), np.uint64)
    phrase = joined(t.column("phrase"), np.uint64)[0]
    q = np.repeat(t.column("q").to_numpy(), n)
    order = np.lexsort((q, phrase, trigger))
    trigger, phrase, q = trigger[order], phrase[order], q[order]
    new = np.r_[True, trigger[1:] != trigger[:-1]]
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    several = np.bincount(group) > 1
    contested = np.bincount(group, (phrase != phrase[at][group]) | (phrase == 0)) > 0
    again = ~new & (phrase != 0) & (phrase == np.r_[phrase[:1], phrase[:-1]])
    kind = np.where(again, 1, np.where(several[group] & contested[group], 2, 0)).astype(np.uint8)
    on = kind > 0
    qs, cols = _by_block(q[on], trigger=trigger[on], kind=kind[on])
    return pa.table({"q": pa.array(qs, pa.int32()), "trigger": pa.array(cols["trigger"], pa.binary()), "kind": pa.array(cols["kind"], pa.binary())})


# ---- dictionary ----------------------------------------------------------------------------------


def _work(n: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            q = docs.column("q")[0].as_py()
            r = Runs(_texts(docs)[1])
            known, kinds = joined(replies.column("trigger"), np.uint64)[0], joined(replies.column("kind"), np.uint8)[0]
            order = np.argsort(known, kind="stable")
            known, kinds = known[order], kinds[order]
            kind = np.zeros(len(r.row), dtype=np.int64)
            if len(known) and len(kind):
                i = np.minimum(np.searchsorted(known, r.trigger), len(known) - 1)
                kind = np.where(known[i] == r.trigger, kinds[i], 0).astype(np.int64)
            _, group = np.unique(r.trigger, return_inverse=True)
            _, pid = np.unique(r.phrase ^ (r.trigger * U64(0x9E3779B97F4A7C15)), return_inverse=True)
            low = np.full(group.max() + 1 if len(group) else 0, LAST)
            np.minimum.at(low, group, pid)
            several = np.zeros(len(low), dtype=bool)
            several[group[pid != low[group]]] = True
            several = several[group]
            first = _firsts(pid)
            gone = (kind == 1) | ~first  # an equal phrase came before, here or in another block
            cuts = [_cuts(r.row[gone], r.first[gone], r.last[gone])]
            # several phrases, in this block alone: strings are settled here
            on = np.flatnonzero((kind == 0) & several & first)
            count = r.last[on] - r.first[on] + 1
            length = count + SIZE - 1
            later = _later(np.frombuffer(r.bytes_of(r.row[on], r.first[on], r.last[on]), dtype=np.uint8), np.cumsum(length) - length, count)
            start = ragged(r.first[on], count)[later]
            cuts.append(_cuts(np.repeat(r.row[on], count)[later], start, start))
            # several phrases in several blocks: each piece goes to the dictionary once
            row, a, b, key, whole = r.pieces(np.flatnonzero((kind == 2) & first))
            new = _firsts(whole)
            cuts.append(_cuts(row[~new], a[~new], b[~new]))
            row, a, b, key = row[new], a[new], b[new], key[new]
            bucket = ((key >> U64(32)) * U64(n)) >> U64(32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(order) else []
            for i, j in zip(at, np.r_[at[1:], len(order)] if len(order) else [], strict=True):
                k = order[i:j]
                rows.append((1, int(bucket[i]), q, pa.compress(r.bytes_of(row[k], a[k], b[k]), "zstd", asbytes=True), np.stack([row[k], a[k], b[k]], 1).astype("<i4").tobytes()))
            rows.append((0, q % n, q, _merge(np.concatenate(cuts)).tobytes(), b""))
        kinds_ = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([x[i] for x in rows], k) for i, (c, k) in enumerate(zip(WORK.split(", "), kinds_, strict=True))})

    return run


def _merge(c: np.ndarray) -> np.ndarray:
    """Cut records in order, overlapping and touching ones as one."""
    if not len(c):
        return c
    c = c[np.lexsort((c[:, 1], c[:, 0]))]
    flat = c[:, 0].astype(np.int64) << 32
    end = np.maximum.accumulate(flat + c[:, 2])  # rows ascend, so a row's ends stay below the next row's starts
    new = np.r_[True, flat[1:] + c[1:, 1] > end[:-1]]
    at = np.flatnonzero(new)
    return np.stack([c[at, 0], c[at, 1], (end[np.r_[at[1:], len(c)] - 1] & 0xFFFFFFFF)], 1).astype("<i4")


def suffix_ranks(text: np.ndarray, size: int) -> np.ndarray:
    """Rank of every suffix of text by its first size bytes (size a number from 8 on), by prefix doubling."""
    x = np.concatenate([text, np.zeros(size, dtype=np.uint8)]).astype(np.uint64)
    n, key = len(text), np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        key = key << U64(8) | x[i : n + i]
    rank, have = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
    while have < size:
        by = min(have, size - have)
        after = np.concatenate([rank[by:] + 1, np.zeros(by, dtype=np.int64)])
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        have += by
    return rank


def _later(text: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For dictionary phrases in corpus order (starts at, strings count): which strings an earlier one equals.

    Fingerprints only choose the phrases worth sorting; the order of the suffixes decides.
    """
    if not len(at):
        return np.zeros(0, dtype=bool)
    s = ragged(at, count)
    phrase = np.repeat(np.arange(len(at)), count)
    uniq, inverse, times = np.unique(Roll(text).span(s, s + SIZE), return_inverse=True, return_counts=True)
    twin = times[inverse] > 1
    out = np.zeros(len(s), dtype=bool)
    some = np.unique(phrase[twin])
    if not len(some):
        return out
    # the suffix array of those phrases alone
    length = count[some] + SIZE - 1
    part = text[ragged(at[some], length)]
    where = np.cumsum(length) - length
    rank = suffix_ranks(part, SIZE)[ragged(where, count[some])]
    mine = np.flatnonzero(np.isin(phrase, some))
    out[mine] = ~_firsts(rank)
    return out


def _settle(t: pa.Table) -> pa.Table:
    """One bucket of the dictionary: cuts for each block.  Cuts that blocks know already pass on."""
    tidy()
    if not t.column("kind")[0].as_py():
        return pa.table({"q": t.column("q"), "cuts": t.column("a")})
    where, n = joined(t.column("b"), "<i4")
    where, q = where.reshape(-1, 3).astype(np.int64), np.repeat(t.column("q").to_numpy(), n // 3)
    count = where[:, 2] - where[:, 1] + 1
    length = count + SIZE - 1
    size = np.add.reduceat(length, np.cumsum(n // 3) - n // 3).tolist()
    text = np.frombuffer(b"".join(pa.decompress(x.as_buffer(), k, "zstd", asbytes=True) for x, k in zip(t.column("a"), size, strict=True)), dtype=np.uint8)
    order = np.lexsort((where[:, 1], where[:, 0], q))  # corpus order
    at = (np.cumsum(length) - length)[order]
    where, q, count = where[order], q[order], count[order]
    # the dictionary has each piece once, by its bytes; what repeats a piece goes whole
    raw, seen = text.tobytes(), {}
    new = np.fromiter((seen.setdefault(raw[a:b], i) == i for i, (a, b) in enumerate(zip(at.tolist(), (at + count + SIZE - 1).tolist(), strict=True))), dtype=bool, count=len(at))
    del raw, seen
    later = np.ones(int(count.sum()), dtype=bool)
    later[np.repeat(new, count)] = _later(text, at[new], count[new])
    row, start, q = np.repeat(where[:, 0], count)[later], ragged(where[:, 1], count)[later], np.repeat(q, count)[later]
    edge = np.r_[np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), len(q)] if len(q) else [0]
    cuts = [_merge(_cuts(row[a:b], start[a:b], start[a:b])).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"q": pa.array(q[edge[:-1]] if len(q) else [], pa.int32()), "cuts": pa.array(cuts, pa.binary())})


# ---- operator ------------------------------------------------------------------------------------


def _apply(schema: T.StructType, decode: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = schema.names

    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        rows, texts = _texts(docs)
        c = _merge(joined(cuts.column("cuts"), "<i4")[0].reshape(-1, 3))
        lo, hi = np.searchsorted(c[:, 0], np.arange(len(texts))), np.searchsorted(c[:, 0], np.arange(len(texts)), "right")
        kept, spans = [], []
        for i, x in enumerate(texts):
            mine = c[lo[i] : hi[i], 1:].tolist()
            at, out = 0, []
            for a, b in mine:
                out.append(x[at:a])
                at = b
            kept.append(b"".join(out) + x[at:] if mine else x)
            spans.append([{"start": a, "end": b} for a, b in mine])
        if not decode:
            return pa.table([rows.field(0), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], names=names)
        fields = [rows.field(i) for i in range(rows.type.num_fields)]
        was = fields[names.index("text")].is_null().to_pylist()
        new = [None if z else k.decode("utf-8", "ignore") for k, z in zip(kept, was, strict=True)]
        fields[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            fields[i] = refit(pa.array([None if x is None else len(x) for x in new], pa.int64()), fields[i].type)
        return pa.table(fields, names=names)

    return run


class Blocks:
    """Blocks of ascending (doc_id, hash of text) and about BLOCK bytes of text.

    Ranges of doc_id between quantiles are weighed; light neighbours form a block together, a heavy range is
    cut at even distances, and one of a single doc_id (or of none) at even distances of the hash.
    """

    def __init__(self, rows: DataFrame, size: int):
        total = rows.agg(F.sum("bytes")).first()[0] or 0
        n = int(min(RANGES, max(1, 4 * total // size)))
        got = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
        got = np.array(got or [], dtype=np.int64)
        alone = got[1:][(got[1:] == got[:-1]) & (got[1:] < LAST)] + 1  # a doc_id of several quantiles is a range of its own
        self.bounds = np.unique(np.r_[got, alone])
        place = self.place
        weight = {r["r"]: r["bytes"] for r in rows.groupBy(F.pandas_udf(lambda k: pd.Series(place(k.to_numpy()).astype(np.int32)), "int")("key").alias("r")).agg(F.sum("bytes").alias("bytes")).collect()} if n > 1 else {0: total}  # at most RANGES rows
        ranges = len(self.bounds) + 1
        self.low = np.r_[-(2**63), self.bounds].astype(np.float64)
        self.width = np.maximum(np.r_[self.bounds, LAST].astype(np.float64) - self.low, 1)
        self.single = np.r_[False, np.diff(self.bounds) == 1, self.bounds[-1:] == LAST] if len(self.bounds) else np.array([False])
        self.base, self.parts = np.zeros(ranges, dtype=np.int64), np.ones(ranges, dtype=np.int64)
        q, held = 0, 0
        for r in range(ranges):
            w = weight.get(r) or 0
            if held and held + w > size:
                q, held = q + 1, 0
            self.base[r], self.parts[r] = q, max(1, -(-w // size))
            if self.parts[r] > 1:
                q, held = q + int(self.parts[r]), 0
            else:
                held += w
        self.total = q + 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, key, "right")

    def of(self, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        r = self.place(key)
        share = np.where(self.single[r], hash_.astype(np.float64) / 2.0**64 + 0.5, (key.astype(np.float64) - self.low[r]) / self.width[r])
        return (self.base[r] + np.clip((share * self.parts[r]).astype(np.int64), 0, self.parts[r] - 1)).astype(np.int32)


def _settled(docs: DataFrame, decode: bool, schema: T.StructType, size: int) -> DataFrame:
    n = buckets(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    blocks = Blocks(docs.select(key.alias("key"), F.octet_length("text").cast("bigint").alias("bytes")), size)
    q = F.pandas_udf(lambda k, h: pd.Series(blocks.of(k.to_numpy(), h.to_numpy())), "int")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), F.xxhash64("text").alias("hash")).withColumn("q", q("key", "hash"))
    replies = held.groupBy("q").applyInArrow(_parse(n), PARSE).groupBy("bucket").applyInArrow(_reply, REPLY)
    work = held.groupBy("q").cogroup(replies.groupBy("q")).applyInArrow(_work(n), WORK)
    cuts = work.groupBy("kind", "bucket").applyInArrow(_settle, CUTS)
    return held.groupBy("q").cogroup(cuts.groupBy("q")).applyInArrow(_apply(schema, decode), schema)


def remove_repeats(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, kept (remaining bytes) and spans (removed bytes, maximal) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _settled(rows, False, T._parse_datatype_string("doc_id bigint, kept binary, spans array<struct<start:int,end:int>>"), size)


def strip_repeats(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character cut in two is dropped, n_chars follows.  All columns stay, whatever their names."""
    return _settled(docs, True, docs.schema, size)
