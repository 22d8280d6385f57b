"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every token is predicted from the SIDE tokens on both sides.  The network knows symbols: the corpus's
most frequent words, counted over all documents, and a bucket by word ending for each of the others.
Position matrices of the window's symbols are summed and squashed, and a two-level softmax (class, then
member) gives the symbol's probability.  A word that shares a bucket is then told apart inside it, by
counts of the other documents of the corpus: how often it stands between the same two neighbours, backed
off to how often it occurs, backed off to a spelling byte by byte.  Both factors together are the token's
conditional probability, so the vocabulary is open, and what is counted grows with the corpus.

Training is data-parallel local descent: documents are dealt by a hash of their rows into shards of
about SHARD bytes, every shard takes its steps from the same start, and the token-weighted mean of all
shards' weights, summed up in a tree, is the next round's start.  Every position of every document is a
target in exactly one round.  Neither shards nor steps depend on how the rows lie in files or
partitions.  A document's score is the sum of its tokens' log-probabilities.

doc_id is returned as bigint.  A null text counts as empty and scores 0 over 0 tokens.  Repeated rows
are scored one by one, and count as other documents to each other.  An empty table trains nothing and
returns nothing.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, Roll, Spans, blocks, buckets, joined, materialize, mix, packed, raw_bytes, seg_sum, text_block, tidy

CLASSES, MEMBERS, ENDINGS = 64, 64, 256
VOCAB = CLASSES * MEMBERS
WORDS = VOCAB - ENDINGS
SIDE, DIM = 2, 16
#: Round r takes the positions r, r + ROUNDS, ... of every document as targets, BATCH to a step.
ROUNDS, RATE, BATCH = 2, 0.4, 4096
#: Bytes of text of a shard in training and of a group in scoring; tokens worked on at a time.
SHARD, GROUP, LOT = 16 << 20, 4 << 20, 1 << 17
#: A task's word counts go out when it holds so many distinct words.
FLUSH = 1_500_000
#: Rows of a tile of the member level, and arrays that a node of the tree of means sums up.
TILE, FAN = 64, 16
STATS = "kind int, key bigint, total bigint, distinct bigint"


class Tokens:
    def __init__(self, texts: list[bytes]):
        self.buf, self.first, self.end = text_block(texts)
        self.spans = Spans(self.buf, self.first, self.end, PUNCT)
        self.roll = Roll(self.buf)
        self.hashes = self.roll.span(self.spans.s, self.spans.e)

    @cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, a token of each, and each token's place among them."""
        return np.unique(self.hashes, return_index=True, return_inverse=True)

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct hashes: their places among words, and whether they are there."""
        uniq = self.distinct[0]
        if not len(words):
            return np.zeros(len(uniq), dtype=np.int64), np.zeros(len(uniq), dtype=bool)
        i = np.minimum(np.searchsorted(words, uniq), len(words) - 1)
        return i, words[i] == uniq

    def pairs(self, on: np.ndarray) -> np.ndarray:
        """Keys of tokens in their places: 48 bits of a hash of both neighbours and the ending, 16 bits of the word."""
        h, d = np.concatenate([self.hashes, np.zeros(2, dtype=np.uint64)]), np.concatenate([self.spans.doc, [-1, -1]])
        left, right = np.where(d[on - 1] == d[on], h[on - 1], U64(0)), np.where(d[on + 1] == d[on], h[on + 1], U64(0))
        near = mix(mix(left + U64(0x632BE59BD9B4E019)) * U64(0x9E3779B97F4A7C15) + right + self.endings(on).astype(np.uint64))
        return (near & ~U64(0xFFFF)) | (mix(h[on]) & U64(0xFFFF))

    def endings(self, on: np.ndarray) -> np.ndarray:
        """Bucket of tokens by their last three bytes."""
        e = self.spans.e[on]
        return (self.roll.span(np.maximum(self.spans.s[on], e - 3), e) % U64(ENDINGS)).astype(np.int64)

    def symbols(self, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Symbols: of the known words (hashes in order, their ids), else by ending."""
        i, on = self.known(words)
        out = WORDS + self.endings(self.distinct[1])
        out[on] = ids[i[on]]
        return out[self.distinct[2]]

    def spelled(self, on: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Log-probability of tokens' bytes before their last three, and of the end."""
        sums = np.zeros(len(self.buf) + 1)
        np.cumsum(letters[self.buf], out=sums[1:])
        s, e = self.spans.s[on], self.spans.e[on]
        return sums[np.maximum(s, e - 3)] - sums[s] + letters[256]


def contexts(sym: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Symbols at -SIDE..-1 and 1..SIDE of each token; VOCAB outside the text."""
    n, out = len(sym), np.full((2 * SIDE, len(sym)), VOCAB, dtype=np.int64)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if b > a:
            same = doc[a:b] == doc[a + d : b + d]
            out[j, a:b][same] = sym[a + d : b + d][same]
    return out


def targets(doc: np.ndarray, at: np.ndarray, r: int) -> np.ndarray:
    """Tokens that are targets in round r; doc: each token's text, at: where each text's tokens begin."""
    return np.flatnonzero((np.arange(len(doc)) - at[doc]) % ROUNDS == r)


# ---- network -------------------------------------------------------------------------------------


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"u": rng.normal(0, 0.1, (2 * SIDE, VOCAB + 1, DIM)), "c": rng.normal(0, 0.1, (CLASSES, DIM)), "m": rng.normal(0, 0.1, (CLASSES, MEMBERS, DIM)), "cb": np.zeros(CLASSES), "mb": np.zeros((CLASSES, MEMBERS))}
    return {k: x.astype(np.float32) for k, x in w.items()}


def _hidden(w: dict, ctx: np.ndarray) -> np.ndarray:
    h = np.take(w["u"][0], ctx[0], axis=0)
    for j in range(1, len(ctx)):
        h += np.take(w["u"][j], ctx[j], axis=0)
    return np.tanh(h, out=h)


def _exp(z: np.ndarray, at: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of logits: those at the places, exponentials (in place of z) and their sums."""
    if z.size and not z.max() <= 60:  # to look costs less than to cut
        np.minimum(z, 60, out=z)
    picked = z[at]
    np.exp(z, out=z)
    return picked, z, z @ np.ones(z.shape[1], dtype=np.float32)


class _Tiles:
    """Rows sorted by class and padded to tiles of TILE rows of one class, so that the members' matrices multiply in one batch."""

    def __init__(self, cls: np.ndarray):
        self.order = np.argsort(cls.astype(np.uint16), kind="stable")  # 16 bits sort by radix
        self.count = np.bincount(cls, minlength=CLASSES)
        tiles = -(-self.count // TILE)
        self.first = np.cumsum(tiles) - tiles
        c = cls[self.order]
        self.place = self.first[c] * TILE + np.arange(len(cls)) - (np.cumsum(self.count) - self.count)[c]
        self.of = np.repeat(np.arange(CLASSES), tiles)

    def put(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.of) * TILE, h.shape[1]), dtype=np.float32)
        out[self.place] = h[self.order]
        return out.reshape(-1, TILE, h.shape[1])

    def logits(self, h: np.ndarray, members: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = np.matmul(h, members.transpose(0, 2, 1))
        z += bias[self.of][:, None, :]
        return z.reshape(-1, MEMBERS)


def log_probs(w: dict, sym: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    cls, mem = sym % CLASSES, sym // CLASSES
    out, h = np.zeros(len(sym)), np.zeros((len(sym), DIM), dtype=np.float32)
    for a in range(0, len(sym), BATCH):
        h[a : a + BATCH] = _hidden(w, ctx[:, a : a + BATCH])
        z = h[a : a + BATCH] @ w["c"].T
        z += w["cb"]
        z, _, s = _exp(z, (np.arange(len(z)), cls[a : a + BATCH]))
        out[a : a + BATCH] = z - np.log(s)
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    h, mem = np.take(h, order, axis=0), mem[order]
    end = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    for c, (i, j) in enumerate(zip([0, *end[:-1]], end, strict=True)):
        for a in range(i, j, BATCH):
            b = min(a + BATCH, j)
            z = h[a:b] @ w["m"][c].T
            z += w["mb"][c]
            z, _, s = _exp(z, (np.arange(b - a), mem[a:b]))
            out[order[a:b]] += z - np.log(s)
    return out


def step(w: dict, sym: np.ndarray, ctx: np.ndarray, rate: float) -> None:
    """One gradient step on the mean log-probability of the tokens, in place."""
    n = len(sym)
    h = _hidden(w, ctx)
    cls, mem = sym % CLASSES, sym // CLASSES
    rate32 = np.float32(rate)
    _, p, s = _exp(h @ w["c"].T + w["cb"], (np.arange(n), cls))
    p /= s[:, None]
    p[np.arange(n), cls] -= 1
    dh = p @ w["c"]
    t = _Tiles(cls)
    rows, members = t.put(h), w["m"][t.of]
    _, q, s = _exp(t.logits(rows, members, w["mb"]), (t.place, mem[t.order]))
    scale = np.zeros(len(q), dtype=np.float32)  # 0 for padding
    scale[t.place] = 1 / s[t.place]
    q *= scale[:, None]
    q[t.place, mem[t.order]] -= 1
    q = q.reshape(-1, TILE, MEMBERS)
    dh[t.order] += np.matmul(q, members).reshape(-1, DIM)[t.place]
    by = (rate32 / t.count[t.of].astype(np.float32))[:, None]
    rows *= by[:, :, None]
    gm, gb = np.matmul(q.transpose(0, 2, 1), rows), np.matmul(np.ones(TILE, dtype=np.float32), q) * by
    one = np.flatnonzero(t.count)
    w["m"][one] -= gm[t.first[one]]
    w["mb"][one] -= gb[t.first[one]]
    for i in np.flatnonzero(t.of[1:] == t.of[:-1]) + 1:  # further tiles of frequent classes
        w["m"][t.of[i]] -= gm[i]
        w["mb"][t.of[i]] -= gb[i]
    w["c"] -= (p.T @ h) * (rate32 * 8 / n)
    w["cb"] -= (np.ones(n, dtype=np.float32) @ p) * (rate32 * 8 / n)
    dh *= 1 - h * h
    # all positions at once: 16 bits hold position and symbol
    key = (ctx + (np.arange(len(ctx)) * (VOCAB + 1))[:, None]).astype(np.uint16).ravel()
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    g = np.add.reduceat(np.take(dh, order % n, axis=0).view(np.complex64), at, axis=0).view(np.float32)  # two components to an addition
    g *= rate32 / np.sqrt(np.diff(np.r_[at, len(k)]).astype(np.float32))[:, None]  # frequent symbols take damped sums
    w["u"].reshape(-1, DIM)[k[at]] -= g


def train_shard(w: dict, sym: np.ndarray, count: np.ndarray, r: int) -> int:
    """Round r over a shard (symbols of its documents end to end, tokens of each), in place; the number of targets."""
    end = np.cumsum(count)
    seen, i = 0, 0
    while i < len(count):
        a = int(end[i] - count[i])
        j = max(i + 1, int(np.searchsorted(end, a + LOT, "right")))
        doc = np.repeat(np.arange(j - i), count[i:j])
        s = sym[a : int(end[j - 1])].astype(np.int64)
        on = targets(doc, np.r_[0, end[i:j] - a], r)
        ctx = contexts(s, doc)[:, on]
        for b in range(0, len(on), BATCH):
            step(w, s[on[b : b + BATCH]], ctx[:, b : b + BATCH], RATE / (1 + r))
        seen += len(on)
        i = j
    return seen


# ---- counts --------------------------------------------------------------------------------------


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order, with their counts and endings."""
    h, c, e = (np.concatenate([x[i] for x in held]) for i in range(3))
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[at], np.add.reduceat(c[order], at) if len(h) else c, e[order][at]


def _count(n: int):
    """Of a task's documents: counts and endings of its words, packed by bucket; counts of bytes and tokens, in buckets below 0."""
    names = ["bucket", "word", "count", "ending"]

    def run(batches):
        held, size, letters = [], 0, np.zeros(257, dtype=np.int64)
        for rb in blocks(batches):
            t = Tokens(raw_bytes(rb.column("text")))
            h, first, c = np.unique(t.hashes, return_index=True, return_counts=True)
            letters[:256] += np.bincount(t.buf[~PUNCT[t.buf]], minlength=256)
            letters[256] += len(t.hashes)
            held.append((h, c.astype(np.int64), t.endings(first).astype(np.uint8)))
            size += len(h)
            if size > FLUSH:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    h, c, e = held[0]
                    yield packed(h, n, word=h, count=c, ending=e)
                    held, size = [], 0
        if held:
            h, c, e = _merged(held)
            if len(h):
                yield packed(h, n, word=h, count=c, ending=e)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(h[0] % U64(n))], pa.int32()), pa.array([b""]), pa.array([letters.tobytes()]), pa.array([b""])], names=names)

    return run


def _stats(t: pa.Table) -> pa.Table:
    """Of a bucket: 0 its most frequent words; 1 tokens and distinct words of each ending; 2 bytes and (256) tokens."""
    counts = joined(t.column("count"), np.int64)[0]
    if t.column("bucket")[0].as_py() < 0:
        total = counts.reshape(-1, 257).sum(0)
        return _rows([2] * 257, np.arange(257), total, np.zeros(257, dtype=np.int64))
    h, c, e = _merged([(joined(t.column("word"), np.uint64)[0], counts, joined(t.column("ending"), np.uint8)[0])])
    top = np.lexsort((h.view(np.int64), -c))[:WORDS]
    by, kinds = np.bincount(e, c, minlength=ENDINGS).astype(np.int64), np.bincount(e, minlength=ENDINGS)
    return pa.concat_tables([_rows([0] * len(top), h[top].view(np.int64), c[top], e[top].astype(np.int64)), _rows([1] * ENDINGS, np.arange(ENDINGS), by, kinds)])


def _rows(kind, key, total, distinct) -> pa.Table:
    return pa.table([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(total, pa.int64()), pa.array(distinct, pa.int64())], names=[x.split()[0] for x in STATS.split(", ")])


def _best(t: pa.Table) -> pa.Table:
    order = np.lexsort((t.column("key").to_numpy(), -t.column("total").to_numpy()))[:WORDS]
    return t.select([x.split()[0] for x in STATS.split(", ")]).take(pa.array(order))


class Counts:
    """What scoring must know of the corpus: fixed in size.

    words, ids: hashes of the most frequent words (in order) and their symbols; tokens, kinds: tokens and
    distinct words of each ending besides those; letters: log-probabilities of bytes and of a word's end.
    """

    def __init__(self, docs: DataFrame):
        n = buckets(docs.sparkSession)
        table = docs.select("text").mapInArrow(_count(n), "bucket int, word binary, count binary, ending binary").groupBy("bucket").applyInArrow(_stats, STATS)
        table = materialize(table, "lm-counts")
        top, width = table.where("kind = 0"), n
        while width > FAN:  # a tree: no task reads more than FAN nodes' words
            width = -(-width // FAN)
            top = top.groupBy(F.pmod("key", F.lit(width)).alias("node")).applyInArrow(_best, STATS)
        top = top.orderBy(F.desc("total"), "key").limit(WORDS).toArrow()
        words = top.column("key").to_numpy().view(np.uint64)
        order = np.argsort(words)
        self.words, self.ids = words[order], order.astype(np.int64)
        self.tokens, self.kinds, letters = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(257)
        for r in table.where("kind > 0").groupBy("kind", "key").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect():  # at most 513 rows
            if r["kind"] == 1:
                self.tokens[r["key"]], self.kinds[r["key"]] = r["total"], r["distinct"]
            else:
                letters[r["key"]] = r["total"]
        ending = top.column("distinct").to_numpy()
        self.tokens -= np.bincount(ending, top.column("total").to_numpy(), minlength=ENDINGS)
        self.kinds -= np.bincount(ending, minlength=ENDINGS)
        self.letters = np.log((letters + 0.5) / (letters + 0.5).sum())


# ---- training ------------------------------------------------------------------------------------


def _dealt(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text, a hash of both, and q: the part of about size bytes of text that the hash gives."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size)
    h = F.xxhash64("doc_id", "text")
    return rows.withColumn("h", h).withColumn("q", F.pmod(h, F.lit(max(1, n))))


def _symbolise(held):
    def run(batches):
        for rb in blocks(batches):
            t = Tokens(raw_bytes(rb.column("text")))
            sym = t.symbols(*held.value).astype("<u2")
            yield pa.RecordBatch.from_arrays([rb.column("q"), rb.column("h"), pa.array([sym[a:b].tobytes() for a, b in zip(t.spans.at[:-1].tolist(), t.spans.at[1:].tolist(), strict=True)], pa.binary())], names=["q", "h", "sym"])

    return run


def _shard(t: pa.Table) -> pa.Table:
    t = t.sort_by([("h", "ascending"), ("sym", "ascending")])
    raw = t.column("sym").to_pylist()
    count = np.array([len(x) // 2 for x in raw], dtype=np.int64)
    return pa.table({"q": t.column("q").slice(0, 1), "sym": pa.array([b"".join(raw)], pa.binary()), "count": pa.array([count.tobytes()], pa.binary())})


def _mean(t: pa.Table) -> pa.Table:
    """One array of several shards: their mean, weighted by targets, in the order of the shards."""
    t = t.sort_by("q")
    total, n = 0.0, 0
    for x, k in zip(t.column("value"), t.column("n").to_pylist(), strict=True):
        total = total + np.frombuffer(x.as_buffer(), dtype=np.float32).astype(np.float64) * k
        n += k
    return pa.table({"q": pa.array([t.column("q")[0].as_py() // FAN], pa.int64()), "name": t.column("name").slice(0, 1), "value": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def train(docs: DataFrame, words: np.ndarray, ids: np.ndarray, shard: int = SHARD) -> dict[str, np.ndarray]:
    sc = docs.sparkSession.sparkContext
    w = start()
    dealt = _dealt(docs, shard)
    known = sc.broadcast((words, ids))
    shards = materialize(dealt.mapInArrow(_symbolise(known), "q bigint, h bigint, sym binary").where("length(sym) > 0").groupBy("q").applyInArrow(_shard, "q bigint, sym binary, count binary"), "lm-shards")
    width = (shards.agg(F.max("q")).first()[0] or 0) + 1
    for r in range(ROUNDS):
        held = sc.broadcast(w)

        def local(batches, held=held, r=r):
            for rb in batches:
                for i in range(rb.num_rows):
                    w = {k: x.copy() for k, x in held.value.items()}
                    n = train_shard(w, np.frombuffer(rb.column("sym")[i].as_buffer(), "<u2"), np.frombuffer(rb.column("count")[i].as_buffer(), np.int64), r)
                    if n:
                        yield pa.RecordBatch.from_pydict({"q": pa.array([rb.column("q")[i].as_py()] * len(w)), "name": pa.array(list(w)), "value": pa.array([x.tobytes() for x in w.values()], pa.binary()), "n": pa.array([n] * len(w))})
                    tidy()

        parts, k = shards.mapInArrow(local, "q bigint, name string, value binary, n bigint"), width
        while k > 1:
            parts = parts.groupBy("name", F.expr(f"q div {FAN}").alias("node")).applyInArrow(_mean, "q bigint, name string, value binary, n bigint")
            k = -(-k // FAN)
        for row in parts.collect():  # the model itself, of fixed size
            w[row["name"]] = np.frombuffer(row["value"], dtype=np.float32).reshape(w[row["name"]].shape).copy()
    return w


# ---- scoring -------------------------------------------------------------------------------------


def _lots(t: pa.Table):
    """A group's rows in a fixed order, in lots: their ids, and their tokens."""
    tidy()
    t = t.sort_by([("h", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    for rb in t.to_batches():
        for b in blocks([rb]):
            yield b.column("doc_id"), Tokens(raw_bytes(b.column("text")))


def _ask(n: int, held):
    def run(t: pa.Table) -> pa.Table:
        q, words = t.column("q")[0].as_py(), held.value[0].words
        found: tuple[list, list] = ([], [])
        for _, tok in _lots(t):
            out = ~tok.known(words)[1]
            none = np.zeros(out.sum(), dtype=np.uint8)
            found[0].append((tok.distinct[0][out], np.bincount(tok.distinct[2], minlength=len(out))[out], none))
            key, times = np.unique(tok.pairs(np.flatnonzero(out[tok.distinct[2]])), return_counts=True)
            found[1].append((key, times, np.zeros(len(key), dtype=np.uint8)))
        rows = []
        for kind in (0, 1):
            key, times, _ = _merged(found[kind])
            if len(key):
                p = packed(key, n, key=key, times=times.astype("<u4"))
                rows.append(pa.table([pa.array([kind] * p.num_rows, pa.int32()), p.column(0), pa.array([q] * p.num_rows, pa.int64()), p.column(1), p.column(2)], names=["kind", "bucket", "q", "key", "times"]))
        return pa.concat_tables(rows) if rows else pa.table([pa.nulls(0, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=["kind", "bucket", "q", "key", "times"])

    return run


def _tell(t: pa.Table) -> pa.Table:
    """A bucket's keys: to each group that asked, in the order of its question, their counts in the corpus; of pairs, those of their neighbours before."""
    h, n = joined(t.column("key"), np.uint64)
    times = joined(t.column("times"), "<u4")[0]
    uniq, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, times, minlength=len(uniq))
    if t.column("kind")[0].as_py():
        near = uniq >> U64(16)
        new = np.r_[True, near[1:] != near[:-1]]
        place = np.cumsum(new) - 1
        total = np.stack([np.bincount(place, total)[place], total], 1)
    total = total.astype("<f4")[inverse]
    end = np.cumsum(n)
    return pa.table({"q": t.column("q"), "kind": t.column("kind"), "bucket": t.column("bucket"), "total": pa.array([total[a:b].tobytes() for a, b in zip((end - n).tolist(), end.tolist(), strict=True)], pa.binary())})


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each item's key occurs in its own document."""
    _, place, times = np.unique(mix(key + doc.astype(np.uint64) * U64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    return times[place]


def _inside(tok: Tokens, out: np.ndarray, on: np.ndarray, key: np.ndarray, totals: np.ndarray, near: np.ndarray, k: Counts) -> np.ndarray:
    """Log-probabilities of tokens inside their buckets by the counts of the other documents.

    out: which distinct words are not among the most frequent, totals: their counts; on, key: their tokens and those' pairs(),
    near: the counts of these.
    """
    uniq, at = tok.distinct[0][out], tok.distinct[1][out]
    which, doc = (np.cumsum(out) - 1)[tok.distinct[2][on]], tok.spans.doc[on]
    e = tok.endings(at)
    kinds = np.maximum(k.kinds[e], 1)
    new = np.log(kinds) + tok.spelled(at, k.letters)
    others = totals[which] - _own(doc, uniq[which])
    p = np.where(others > 0, np.log(np.maximum(others, 1) + np.exp(new)[which]), new[which]) - np.log(k.tokens[e] + kinds)[which]
    there, here = near.T.astype(np.float64)
    here, there = here - _own(doc, key), there - _own(doc, key >> U64(16))
    return np.where(here > 0, np.log(np.maximum(here, 1) + np.exp(p)), p) - np.log1p(np.maximum(there, 0))


def _score(held):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            k, w = held.value
            told = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
            cut = told.column("kind").to_pylist().count(0)
            totals = joined(told.column("total").slice(0, cut), "<f4")[0].astype(np.int64)
            near = joined(told.column("total").slice(cut), "<f4")[0].reshape(-1, 2)
            lots = list(_lots(docs))
            far = [~t.known(k.words)[1] for _, t in lots]
            ons = [np.flatnonzero(x[t.distinct[2]]) for (_, t), x in zip(lots, far, strict=True)]
            keys = [t.pairs(on) for (_, t), on in zip(lots, ons, strict=True)]
            # replies come in the order of the group's distinct words and keys
            words = np.unique(np.concatenate([t.distinct[0][x] for (_, t), x in zip(lots, far, strict=True)]), return_inverse=True)[1]
            pairs = np.unique(np.concatenate(keys), return_inverse=True)[1]
            words = np.split(words, np.cumsum([x.sum() for x in far])[:-1])
            pairs = np.split(pairs, np.cumsum([len(x) for x in keys])[:-1])
            for (ids, t), x, on, key, word, pair in zip(lots, far, ons, keys, words, pairs, strict=True):
                sym = t.symbols(k.words, k.ids)
                ctx = contexts(sym, t.spans.doc)
                p = np.concatenate([np.zeros(0)] + [log_probs(w, sym[a : a + LOT], ctx[:, a : a + LOT]) for a in range(0, len(sym), LOT)])
                p[on] += _inside(t, x, on, key, totals[word], near[pair], k)
                out.append((ids, t.spans.count, seg_sum(p, t.spans.at[:-1], t.spans.at[1:])))
        ids = pa.chunked_array([x[0] for x in out], pa.int64())
        n, total = (np.concatenate([np.zeros(0, dtype=d), *(x[i] for x in out)]) for i, d in ((1, np.int64), (2, np.float64)))
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "pll": pa.array(total), "mean_pll": pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0))})

    return run


def score(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, n_tokens, pll (sum of log-probabilities) and their mean, of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    counts = Counts(docs)
    held = spark.sparkContext.broadcast((counts, train(docs, counts.words, counts.ids, shard)))
    dealt = _dealt(docs, GROUP)
    asked = dealt.groupBy("q").applyInArrow(_ask(buckets(spark), held), "kind int, bucket int, q bigint, key binary, times binary")
    told = asked.groupBy("kind", "bucket").applyInArrow(_tell, "q bigint, kind int, bucket int, total binary")
    return dealt.groupBy("q").cogroup(told.groupBy("q")).applyInArrow(_score(held), "doc_id bigint, n_tokens bigint, pll double, mean_pll double")
