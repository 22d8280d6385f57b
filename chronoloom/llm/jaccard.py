"""Near-duplicate join by Jaccard similarity of word shingles, with Bayesian candidate pruning.

Words are runs outside space and tab to carriage return; a text's set holds its runs of five words, or
all its words as one where they are fewer.  Rows of equal sets form one text class, which goes on as one.
Classes that share a MinHash band key meet in that key's set, and equal sets of several bands meet once.
There the MinHash values of pairs are compared a few at a time; a pair is dropped once the posterior
probability (uniform prior) that its similarity reaches the threshold falls below TOLERANCE.  Only what
survives connects classes to groups: of each set a spanning forest of the surviving pairs leaves its
task.  Inside a group the pairs are pruned in the same way and the rest verified by exact set
intersection.  Large sets and groups are dealt into blocks, each pair of blocks a task of its own; no
pair of classes leaves a task, only link counts and spanning forests.

Result, a row for each row of docs: class_id, the smallest doc_id of the rows linked with it directly or
in a chain (its own if none), text_class, the smallest doc_id with the same set, and n_links, how many
other rows have similarity THRESHOLD or more.  doc_id is returned as bigint.  Texts without words, null
ones too, link to nothing, and so do rows without doc_id.  Rows that repeat a doc_id are documents of
their own, whose texts alone link them.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WHITE, Roll, Spans, blocks, buckets, fresh, joined, materialize, mix, packed, ragged, raw_bytes, text_block
from .components import components

WORDS = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Classes and bytes of shingles of a block; pairs compared at a time; sets up to ALL classes are compared pair by pair.
BLOCK, BLOCK_BYTES, LOT, ALL = 512, 8 << 20, 1 << 16, 24
_rng = np.random.default_rng(1729)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
FEATURES = "doc_id bigint, th bigint, key1 bigint, key2 bigint, n int, bands binary, sketch binary"


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end (ascending within a text), and how many each has."""
    buf, first, end = text_block(texts)
    w = Spans(buf, first, end, WHITE)
    h = Roll(buf).span(w.s, w.e)
    if not len(h):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    h = np.concatenate([h, np.zeros(WORDS, dtype=np.uint64)])
    key, at = np.zeros(len(w.s), dtype=np.uint64), np.arange(len(w.s))
    left = w.at[1:][w.doc] - at  # words from here to the text's end
    for i in range(WORDS):
        key = np.where(left > i, mix(key * U64(0x9E3779B97F4A7C15) + h[at + i]), key)
    on = (left >= WORDS) | (at == w.at[:-1][w.doc])  # the only one of a short text starts at its first word
    key, doc = key[on], w.doc[on]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    return key[new], np.bincount(doc[new], minlength=len(texts))


def signatures(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """MinHash values (uint32), a row for each text; texts without shingles get zeros."""
    out = np.zeros((len(n), HASHES), dtype=np.uint32)
    some = n > 0
    at = (np.cumsum(n) - n)[some]
    if len(at):
        for i in range(HASHES):
            v = ((key * _MUL[i] + _ADD[i]) >> U64(32)).astype(np.uint32)
            out[some, i] = np.minimum.reduceat(v, at)
    return out


def set_keys(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed shingles for each text: with their number, they stand for the set."""
    end, out = np.cumsum(n), []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99):
        c = np.r_[U64(0), np.cumsum(mix(key * U64(salt)), dtype=np.uint64)]
        out.append((c[end] - c[end - n]).view(np.int64))
    return out[0], out[1]


def sketches(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The low eight bits of the MinHash values: equal where those are, else rarely."""
    return signatures(key, n).astype(np.uint8)


def _features(batches):
    for rb in blocks(batches):
        key, n = shingles(raw_bytes(rb.column("text")))
        sig = signatures(key, n)
        s, band = sig.astype(np.uint64), np.zeros((len(n), BANDS), dtype=np.uint64)
        for i in range(ROWS):
            band = mix(band * U64(0x9E3779B97F4A7C15) + s[:, i::ROWS] + np.arange(BANDS, dtype=np.uint64) * U64(0x632BE59BD9B4E019))
        sums, low = set_keys(key, n), sig.astype(np.uint8)
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("th"), pa.array(sums[0]), pa.array(sums[1]), pa.array(n.astype(np.int32)), pa.array([r.tobytes() for r in band], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())], names=[c.split()[0] for c in FEATURES.split(", ")])


def _keys(n: int):
    """Band keys of classes, packed by bucket."""

    def run(batches):
        for rb in batches:
            raw = rb.column("bands").to_pylist()
            key = np.frombuffer(b"".join(raw), dtype=np.uint64)
            p = packed(key, n, key=key, id=np.repeat(rb.column("id").to_numpy(), BANDS))
            if p is not None:
                yield p

    return run


def _meet(t: pa.Table) -> pa.Table:
    """Of a bucket's keys: the members of each set of two classes or more, equal sets once; print stands for the set."""
    key, doc = joined(t.column("key"), np.uint64)[0], joined(t.column("id"), np.int64)[0]
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[new, len(key)])
    sums = np.add.reduceat(mix(doc.view(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1)), new)
    on = np.flatnonzero(size > 1)
    on = on[np.unique(sums[on], return_index=True)[1]]
    return pa.table({"print": pa.array(np.repeat(sums[on].view(np.int64), size[on])), "size": pa.array(np.repeat(size[on], size[on]).astype(np.int32)), "id": pa.array(doc[ragged(new[on], size[on])])})


def least_matches(threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared: the fewest matches with which a pair stays.

    With m matches among n and a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1), and
    its mass from t on is the probability of at most m successes among n + 1 draws of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


LEAST = least_matches()


def _pairs(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a[i], b[i]: those that survive the incremental comparison."""
    out: tuple[list, list] = ([], [])
    for i in range(0, len(a), LOT):
        x, y = a[i : i + LOT], b[i : i + LOT]
        match = np.zeros(len(x), dtype=np.int32)
        for n, least in LEAST.items():
            if not len(x):
                break
            match += (sig[x, n - STEP : n] == sig[y, n - STEP : n]).sum(1, dtype=np.int32)
            on = match >= least
            x, y, match = x[on], y[on], match[on]
        out[0].append(x)
        out[1].append(y)
    return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (a, b)


def _reached(sig: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the surviving pairs of a large set; of two sides, only pairs across."""
    two, left, edges = bool(side.any()), np.arange(len(sig)), ([], [])
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            with_ = left[side[left] != side[x]] if two else left
            _, hit = _pairs(sig, np.full(len(with_), x), with_)
            if len(hit):
                edges[0].append(np.full(len(hit), x))
                edges[1].append(hit)
                left = left[~np.isin(left, hit)]
                front += hit.tolist()
    z = np.zeros(0, dtype=np.int64)
    return np.concatenate([z, *edges[0]]), np.concatenate([z, *edges[1]])


def _sorted(t: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The table ordered by columns, and where each run of the first ones begins, with the end."""
    t = t.sort_by([(c, "ascending") for c in by]).combine_chunks()
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for c in by[:-1]:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return t, np.r_[np.flatnonzero(new), t.num_rows]


def _connect(t: pa.Table) -> pa.Table:
    """One task's sets: forests of the pairs that survive pruning."""
    t, cut = _sorted(t, ["print", "size", "id"])
    ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
    sig = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
    size = np.diff(cut)
    small = size <= ALL
    # all pairs of the small sets at once
    first = ragged(cut[:-1][small], size[small])
    later = np.repeat(cut[1:][small], size[small]) - first - 1
    edges = [_pairs(sig, np.repeat(first, later), ragged(first + 1, later))]
    for lo, hi in zip(cut[:-1][~small].tolist(), cut[1:][~small].tolist(), strict=True):
        a, b = _reached(sig[lo:hi], side[lo:hi])
        edges.append((a + lo, b + lo))
    a, b = (ids[np.concatenate([e[i] for e in edges])] for i in (0, 1))
    e = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return pa.table({"u": pa.array(e[:, 0]), "v": pa.array(e[:, 1])})


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of intersections of sets a[i] and b[i]."""
    out = np.zeros(len(a), dtype=np.int64)
    rows = np.unique(np.r_[a, b])
    if len(a) <= 2 * len(rows):  # few pairs: one by one
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            s, t = sets[x], sets[y]
            at = np.minimum(np.searchsorted(s, t), len(s) - 1)
            out[i] = (s[at] == t).sum()
        return out
    place = np.zeros(rows[-1] + 1, dtype=np.int64)
    place[rows] = np.arange(len(rows))
    n = np.array([len(sets[r]) for r in rows])
    _, col = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), n)
    often = np.bincount(col) > 1
    keep = often[col]
    row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
    total = np.zeros((len(rows), len(rows)), dtype=np.float32)  # counts below 2^24 are exact
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(col, (c, c + 4096))
        x = np.zeros((len(rows), 4096), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        total += x @ x.T
    return total[place[a], place[b]].astype(np.int64)


def links(sets: list[np.ndarray], sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among a[i], b[i] whose similarity reaches THRESHOLD."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    p, q = THRESHOLD
    fit = (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p) & (n[a] > 0) & (n[b] > 0)
    a, b = _pairs(sig, a[fit], b[fit])
    both = _overlaps(sets, a, b)
    on = both * q >= (n[a] + n[b] - both) * p
    return a[on], b[on]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def _verify(t: pa.Table) -> pa.Table:
    """One task's groups: link counts weighted by class size, and each class's first one in its tree."""
    t, cut = _sorted(t, ["root", "id"])
    ids, side, size = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("docs").to_numpy()
    one = np.r_[True, ids[1:] != ids[:-1]]  # a class whose row is repeated comes several times
    if not one.all():
        t = t.filter(pa.array(one))
        ids, side, size, cut = ids[one], side[one], size[one], np.r_[0, np.cumsum(one)][cut]
    raw = t.column("shingles").to_pylist()
    count, low = np.zeros(len(ids), dtype=np.int64), ids.copy()
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        sets = [np.frombuffer(r, dtype=np.uint64) for r in raw[lo:hi]]
        sig = sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
        two = side[lo:hi]
        if two.any():  # two blocks: only pairs across
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(two == 0), np.flatnonzero(two == 1), indexing="ij"))
        else:
            a, b = np.triu_indices(hi - lo, 1)
        a, b = links(sets, sig, a, b)
        count[lo:hi] = np.bincount(a, size[lo:hi][b], minlength=hi - lo) + np.bincount(b, size[lo:hi][a], minlength=hi - lo)
        low[lo:hi] = ids[lo:hi][_forest(hi - lo, a, b)]
    on = count > 0
    return pa.table({"id": pa.array(ids[on]), "links": pa.array(count[on]), "low": pa.array(low[on])})


def _sets(batches):
    """Shingles of the classes' first rows; a row of another text under the same doc_id goes."""
    for rb in blocks(batches):
        key, n = shingles(raw_bytes(rb.column("text")))
        k1, k2 = set_keys(key, n)
        end = np.cumsum(n)
        on = (k1 == rb.column("key1").to_numpy()) & (k2 == rb.column("key2").to_numpy()) & (n == rb.column("n").to_numpy())
        rows = pa.array([key[a:b].tobytes() for a, b in zip((end - n)[on].tolist(), end[on].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(rb.column(c).filter(pa.array(on)) for c in ("id", "root", "blocks", "docs")), rows], names=["id", "root", "blocks", "docs", "shingles"])


def _dealt(rows: DataFrame, by: str, tasks: int) -> DataFrame:
    """Rows of sets with task and side: a set of one block shares one of so many tasks, others have a task for each pair of blocks."""
    key, one = F.xxhash64(by), F.col("blocks") == 1
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    return (
        rows.withColumn("own", own).withColumn("other", other)
        .withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("first") == F.col("second"), 0).when(F.col("own") == F.col("first"), 0).otherwise(1))
        .withColumn("task", F.when(one, F.pmod(key, F.lit(tasks))).otherwise(F.xxhash64(by, "first", "second")))
        .withColumn("alone", one)
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of every row of docs; the classes of rows with words and doc_id; and, of classes with links, id, links and tree (another class's id, the same for all of a group)."""
    spark, rows = docs.sparkSession, _rows(docs)
    feats = materialize(rows.mapInArrow(_features, FEATURES), "jaccard-features")
    live = feats.where("n > 0 and doc_id is not null")
    found = live.groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("text_class"), F.count("*").alias("docs"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(found.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")  # ids hold once written
    keys = classes.select("id", "bands").mapInArrow(_keys(buckets(spark)), "bucket int, key binary, id binary")
    near = materialize(keys.groupBy("bucket").applyInArrow(_meet, "print bigint, size int, id bigint").distinct(), "jaccard-sets")
    tasks = max(1, near.count() // BLOCK)
    meet = _dealt(near.join(classes.select("id", "sketch"), "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "print", tasks)
    forest = meet.select("print", "size", "id", "sketch", "side", "task", "alone").groupBy("alone", "task").applyInArrow(_connect, "u bigint, v bigint")
    groups = components(forest, "jaccard-candidates").withColumnRenamed("node", "id").join(classes.drop("bands", "sketch"), "id")
    groups = materialize(groups, "jaccard-groups")
    size = F.col("n").cast("bigint") * 8
    total = groups.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    tasks = max(1, total["rows"] // BLOCK, (total["bytes"] or 0) // BLOCK_BYTES)
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").withColumnRenamed("text_class", "doc_id")
    sets = rows.select("doc_id", "text").join(members.hint("merge"), "doc_id").mapInArrow(_sets, "id bigint, root bigint, blocks int, docs bigint, shingles binary")
    dealt = _dealt(sets, "root", tasks).select("id", "root", "docs", "shingles", "side", "task", "alone")
    linked = materialize(dealt.groupBy("alone", "task").applyInArrow(_verify, "id bigint, links bigint, low bigint"), "jaccard-links")
    tree = components(linked.where("low < id").select(F.col("id").alias("u"), F.col("low").alias("v")), "jaccard-trees").select(F.col("node").alias("id"), F.col("root").alias("tree"))
    return feats, classes.drop("bands", "sketch"), linked.groupBy("id").agg(F.sum("links").alias("links")).join(tree, "id")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_class, n_links of every row of docs (doc_id, text)."""
    feats, classes, linked = text_classes(docs)
    heads = linked.join(classes, "id").groupBy("tree").agg(F.min("text_class").alias("head"))
    about = classes.join(linked.join(heads, "tree"), "id", "left")
    live = feats.where("n > 0 and doc_id is not null")
    with_words = live.join(about, ["key1", "key2", "n"]).select("doc_id", F.coalesce("head", "text_class").alias("class_id"), "text_class", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    without = feats.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_class"), F.lit(0).cast("bigint").alias("n_links"))
    return with_words.unionByName(without)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked rows: that of the smallest doc_id, of several the least hash of text, of equal ones any.

    Rows without words and rows without doc_id stay.  All columns stay, whatever their names.
    """
    feats, classes, linked = text_classes(docs)
    group = F.coalesce("tree", "id").alias("group")
    some = classes.join(linked, "id", "left").where("docs > 1 or tree is not null").select("key1", "key2", "n", group)
    rows = feats.where("n > 0 and doc_id is not null").join(some, ["key1", "key2", "n"]).groupBy("group", "doc_id", "th").count()
    best = rows.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("best"))
    # what goes; and what stays once
    marks = rows.join(best, "group").select("doc_id", "th", "count", (F.col("best") == F.struct("doc_id", "th")).alias("stays")).where("not stays or count > 1")
    doc, th, stays, at = fresh(docs.columns, "doc", "th", "stays", "at")
    marks = marks.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("stays").alias(stays))
    w = Window.partitionBy(doc, th).orderBy(F.lit(0))
    held = docs.withColumns({doc: F.col("doc_id").cast("bigint"), th: F.xxhash64("text")}).join(marks.hint("merge"), [doc, th], "left").withColumn(at, F.row_number().over(w))
    return held.where(F.col(stays).isNull() | (F.col(stays) & (F.col(at) == 1))).select(*(F.col(f"`{c}`") for c in docs.columns))
