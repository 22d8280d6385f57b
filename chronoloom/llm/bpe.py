"""Byte-level BPE encoding and decoding with two-tier lookup, and the piece cache both tokenizers share.

A text is cut before every single space, and around every single line feed, that stands between two
characters other than white space: no match of the pre-token pattern passes such a place, so the
pieces can be encoded one by one and each distinct piece once.  Tier one is a minimal perfect hash of the vocabulary (hash and displace),
which resolves a whole pre-token that is in the vocabulary; the found entry's bytes are compared, so
strangers are told apart.  Tier two merges the bytes of the others: a linked list of parts and a heap
of candidate merges ordered by rank, then by place.

doc_id is returned as bigint.  Null texts count as empty: no ids, and empty decoded bytes.  Repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import U64, Roll, blocks, kept, mix, ragged, rows_of, strings

#: Distinct pieces a worker keeps; beyond it, the most used third stays.  Words: the latest two lots.
PIECES = 600_000
WORDS = 800_000


class Perfect:
    """A minimal perfect hash of byte strings onto 0..n-1, with the strings' ids."""

    def __init__(self, words: list[bytes], ids: list[int]):
        n = self.n = len(words)
        self.buckets = n // 3 + 1
        self.shift = np.zeros(self.buckets, dtype=np.uint64)
        h = hash_words(words)
        order = np.argsort(h % U64(self.buckets), kind="stable")
        bucket = (h % U64(self.buckets))[order]
        cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, n]
        groups = sorted((order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)), key=len, reverse=True)
        free, slot = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
        for g in groups:
            base, step = 0, 16
            while True:
                trials = np.arange(base, base + step, dtype=np.uint64)[:, None]
                at = (mix(h[g][None, :] + trials * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)
                ok = free[at].all(1)
                if len(g) > 1:
                    s = np.sort(at, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    i = int(ok.argmax())
                    break
                base, step = base + step, min(4 * step, 1 << 15)
            self.shift[int(h[g[0]] % U64(self.buckets))] = base + i
            free[at[i]] = False
            slot[g] = at[i]
        self.words: list[bytes] = [b""] * n
        self.ids = np.zeros(n, dtype=np.uint32)
        for w, i, s in zip(words, ids, slot.tolist(), strict=True):
            self.words[s], self.ids[s] = w, i

    def find(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 for those outside."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        h = hash_words(words)
        at = (mix(h + self.shift[(h % U64(self.buckets)).astype(np.int64)] * U64(0x9E3779B97F4A7C15)) % U64(self.n)).astype(np.int64)
        same = np.fromiter((self.words[s] == w for s, w in zip(at.tolist(), words, strict=True)), dtype=bool, count=len(words))
        return np.where(same, self.ids[at].astype(np.int64), -1)


def hash_words(words: list[bytes]) -> np.ndarray:
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(n)
    return Roll(np.frombuffer(b"".join(words), dtype=np.uint8)).span(end - n, end)


class Bpe:
    """A vocabulary of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.perfect = Perfect(list(ranks), list(ranks.values()))
        size = max(ranks.values()) + 1
        n = np.zeros(size, dtype=np.int64)
        for w, i in ranks.items():
            n[i] = len(w)
        self.length, self.start = n, np.cumsum(n) - n
        by_id = {i: w for w, i in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), dtype=np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.wide = np.array(list(map(len, digits)), dtype=np.int64)
        self.digits, self.digit = np.frombuffer(b"".join(digits), dtype=np.uint8), np.cumsum(self.wide) - self.wide

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word outside the vocabulary: the lowest-ranked adjacent pair merges first, leftmost of ties."""
        n, get = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))  # a part goes from its start to the next part's
        rank = [get(word[i : i + 2], -1) for i in range(n)]  # of the pair that starts here
        rank[-1] = -1
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            i = pop(heap)
            r = i >> bits
            i &= low
            if rank[i] != r:
                continue  # one side has merged meanwhile
            j = after[i]
            rank[j] = -1
            end = after[i] = after[j]
            before[end] = i
            if end < n:
                rank[i] = r = get(word[i : after[end]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                rank[i] = -1
            if i:
                k = before[i]
                rank[k] = r = get(word[k:end], -1)
                if r >= 0:
                    push(heap, r << bits | k)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as an array."""
        return self.bytes[ragged(self.start[ids], self.length[ids])]

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimal text, a comma after each."""
        return self.digits[ragged(self.digit[ids], self.wide[ids])]


def _raw(key: str) -> str:
    """A key's text.  Two spaces before: the text as it is.  Line feed before: what follows a line feed;
    two of them: the line feed itself.  Others follow a space."""
    return key[2:] if key.startswith("  ") else "\n" if key == "\n\n" else key[1:] if key.startswith("\n") else " " + key


def _edge(key: str) -> int:
    """1: the piece begins with white space or is empty, 2: it ends so; no cut is valid beside such an edge."""
    if key == "\n\n":
        return 0
    p = key[2:] if key.startswith("  ") else key[1:] if key.startswith("\n") else key
    return 3 if not p else p[0].isspace() + 2 * p[-1].isspace()


class _Codes(dict):
    """Pieces to their codes; a new piece gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class Pieces:
    """Encodes texts piece by piece.

    encode: texts of pieces, and whether each may be put end to end with others (it is one space and
    then characters without a space, no white space at its end), to all ids and each piece's number of them.
    """

    def __init__(self, encode, limit: int = PIECES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.uses = np.zeros(1 << 16, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.at, self.count, self.edge = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Keep the third of the limit that was used most since the last trim."""
        n = len(self.codes)
        best = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.limit // 3])
        names = list(self.codes)
        at, count, edge, ids = self.at[best], self.count[best], self.edge[best], self.ids
        self._clear()
        for i in best.tolist():
            self.codes[names[i]]
        self.codes.new = []
        flat = ids[ragged(at, count)]
        self.ids, self.used = np.concatenate([flat, np.zeros(1 << 20, dtype=np.uint32)]), len(flat)
        pad = np.zeros(1 << 16, dtype=np.int64)
        self.at, self.count, self.edge = (np.concatenate([x, pad]) for x in (np.cumsum(count) - count, count, edge))
        self.uses = np.zeros(len(self.at), dtype=np.int64)

    def _learn(self) -> None:
        new = self.codes.new
        if not new:
            return
        first = len(self.codes) - len(new)
        raw, plain, edge = [], [], []
        for k in new:
            if k.isalnum():
                raw.append(" " + k)
                plain.append(True)
                edge.append(0)
            else:
                e = _edge(k)
                raw.append(_raw(k))
                plain.append(not e and k[0] not in " \n")
                edge.append(e)
        ids, n = self.encode(raw, plain)
        while len(self.at) < len(self.codes):
            self.at, self.count, self.edge, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count, self.edge, self.uses))
        total = len(ids)
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        here = slice(first, len(self.codes))
        self.at[here], self.count[here] = self.used + np.cumsum(n) - n, n
        self.edge[here] = edge
        self.used += total
        self.codes.new = []

    def _split(self, text: str) -> list[str]:
        """Keys of a text's pieces where some space is no valid cut: such pieces stay together."""
        parts, raw = text.split(" "), []
        for i, p in enumerate(parts):
            if i and (not p or not parts[i - 1] or p[0].isspace() or parts[i - 1][-1].isspace()):
                raw[-1] += " " + p
            else:
                raw.append(p if not i else " " + p)
        return ["  " + r for r in raw]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.codes) > self.limit:
            self._trim()
        get, codes, n = self.codes.__getitem__, [], []
        for t in texts:
            parts = t.replace("\n", " \n\n \n").split(" ")
            parts[0] = "  " + parts[0]
            codes.extend(map(get, parts))
            n.append(len(parts))
        self._learn()
        flat, n = np.array(codes, dtype=np.int64), np.array(n, dtype=np.int64)
        end = np.cumsum(n)
        edge = self.edge[flat]
        bad = np.zeros(len(flat), dtype=bool)
        bad[1:] = ((edge[:-1] & 2) | (edge[1:] & 1)) > 0
        bad[end[:-1]] = False
        wrong = np.unique(np.searchsorted(end, np.flatnonzero(bad), "right"))
        if len(wrong):
            rows = np.split(flat, end[:-1])
            for i in wrong.tolist():
                rows[i] = np.array(list(map(get, self._split(texts[i]))), dtype=np.int64)
            self._learn()
            flat, n = np.concatenate(rows), np.array(list(map(len, rows)), dtype=np.int64)
            end = np.cumsum(n)
        self.uses[: len(self.codes)] += np.bincount(flat, minlength=len(self.codes))
        c = self.count[flat]
        sums = np.zeros(len(flat) + 1, dtype=np.int64)
        np.cumsum(c, out=sums[1:])
        return self.ids[ragged(self.at[flat], c)], sums[end] - sums[end - n]


class Encoder(Pieces):
    """Pieces by a Bpe."""

    def __init__(self, bpe: Bpe, limit: int = 2 * PIECES):
        self.bpe, self.find = bpe, regex.compile(bpe.pattern).findall
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        super().__init__(self._encode, limit)

    def _encode(self, pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > WORDS // 2:
            self.words, self.older = {}, self.words
        words, older, find = self.words, self.older, self.find
        # a plain piece of letters alone is one match of the pattern
        split = [[p] if e and p[1:].isalpha() else find(p) for p, e in zip(pieces, plain, strict=True)]
        new = {w for w in chain.from_iterable(split) if w not in words}
        for w in new & older.keys():
            words[w] = older[w]
            new.discard(w)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, i in zip(new, raw, self.bpe.perfect.find(raw).tolist(), strict=True):
            words[w] = [i] if i >= 0 else self.bpe.merge(b)
        out = [words[s[0]] if len(s) == 1 else [i for w in s for i in words[w]] for s in split]
        n = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter(chain.from_iterable(out), dtype=np.uint32, count=int(n.sum())), n


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded bytes of each row of docs (doc_id, text)."""
    return _run(docs, path, pattern, "doc_id bigint, ids binary, decoded binary", lambda ids, out, text: (ids.astype("<u4").tobytes(), out.tobytes()))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode, but ids and bytes only as count and SHA-256."""

    def of(ids, out, text):
        return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(out).hexdigest()

    return _run(docs, path, pattern, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", of)


def _run(docs: DataFrame, path: str, pattern: str, columns: str, of) -> DataFrame:
    """of: one text's ids, decoded bytes and decimal ids with commas to its values; the vocabulary is built once and broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(Bpe.load(path, pattern))
    schema = docs.sparkSession.createDataFrame([], columns).schema
    names = schema.names
    kinds = [{"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in schema][1:]

    def run(batches):
        enc = kept(("bpe", path, pattern), lambda: Encoder(held.value))
        for rb in blocks(batches, keep=True):
            ids, n = enc(strings(rb.column("text")))
            size = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(enc.bpe.length[ids], out=size[1:])
            out, text = enc.bpe.decode(ids), enc.bpe.decimal(ids)
            wide = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(enc.bpe.wide[ids], out=wide[1:])
            end = np.cumsum(n)
            places = zip((end - n).tolist(), end.tolist(), size[end - n].tolist(), size[end].tolist(), wide[end - n].tolist(), wide[end].tolist(), strict=True)
            rows = [of(ids[a:b], out[c:d], text[e : max(e, f - 1)]) for a, b, c, d, e, f in places]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return rows_of(docs).mapInArrow(run, columns)
