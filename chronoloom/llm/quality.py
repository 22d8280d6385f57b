"""Quality rules: counted text statistics, a base rule, and a calibrated hashed n-gram classifier.

Words are runs of bytes outside space and tab to carriage return.  Every count is exact and covers the
whole text.  The classifier is a logistic regression over hashed words and hashed byte n-grams of 3
and 5, each as a share of the text, fitted on labelled rows that pass the base rule and calibrated by
Platt scaling on a fifth of them that the fit has not seen, weighted to the classes' shares among all
labelled rows.  Texts are scored in Arrow batches.

doc_id is returned as bigint.  An empty table gives an empty result.  Null and empty texts have no words and fail the base rule.  Repeated rows are scored one by one.  With
no labelled rows (or one class only) the model keeps whatever passes the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, WHITE, Roll, Spans, blocks, class_weights, labelled_sample, mix, ragged, raw_bytes, rows_of, seg_counts, seg_sum, table_of, text_block, tidy

BITS = 18
#: Fitted on at most SAMPLE texts of each class, none over SAMPLE_BYTES bytes.
SAMPLE, SAMPLE_BYTES = 1000, 10_000
#: A text is kept if its calibrated probability of good quality reaches this.
THRESHOLD = 0.5
SYMBOLS = table_of(b"#*$%&|<>")
WINDOW = 5
COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


@dataclass
class Block:
    buf: np.ndarray
    first: np.ndarray
    end: np.ndarray
    words: Spans
    hashes: np.ndarray
    roll: Roll

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        buf, first, end = text_block(texts)
        words, roll = Spans(buf, first, end, WHITE), Roll(buf)
        return cls(buf, first, end, words, roll.span(words.s, words.e), roll)


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: does an equal one stand earlier in the same text, and does one at all."""
    order = np.argsort(key, kind="stable")  # equal keys stay in text order, so those of a text stand together
    k, d = key[order], doc[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    any_ = same.copy()
    any_[:-1] |= same[1:]
    later, twin = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order], twin[order] = same, any_
    return later, twin


def statistics(b: Block) -> dict[str, np.ndarray]:
    w, n = b.words, len(b.first)
    starts_char = (b.buf & 0xC0) != 0x80
    starts_char &= ~WHITE[b.buf]
    out = {"n_words": w.count, "word_chars": seg_counts(starts_char, b.first, b.end), "n_symbols": seg_counts(SYMBOLS[b.buf], b.first, b.end)}
    # lines: the block has a line feed before and after each text, so lines are what stands between two
    feeds = np.flatnonzero(b.buf == 10)
    ls, le = feeds[:-1] + 1, feeds[1:]
    has = np.searchsorted(w.s, le) > np.searchsorted(w.s, ls)
    ls, le = ls[has], le[has]
    ldoc = np.searchsorted(b.first, ls, "right") - 1
    later, _ = _repeats(b.roll.span(ls, le), ldoc)
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n)
    covered = np.zeros(len(w.s) + 1, dtype=np.int64)
    if len(w.s) >= WINDOW:
        m = len(w.s) - WINDOW + 1
        key = np.zeros(m, dtype=np.uint64)
        for i in range(WINDOW):
            key = mix(key * U64(0x9E3779B97F4A7C15) + b.hashes[i : i + m])
        at = np.flatnonzero(w.doc[:m] == w.doc[WINDOW - 1 :])
        _, twin = _repeats(key[at], w.doc[at])
        hit = at[twin]
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + WINDOW, 1)
    in_window = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(w.doc[in_window], minlength=n)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


def _features(b: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: its bucket at every place, and the places first:end of each text."""
    out = [((b.hashes >> U64(64 - BITS)).astype(np.int64), b.words.at[:-1], b.words.at[1:])]
    x = b.buf.astype(np.uint64)
    code, n = x, 1
    for size, salt in ((3, 0xA24BAED4963EE407), (5, 0x9FB21C651E98DF25)):
        while n < size:
            code, n = code[:-1] | (x[n:] << U64(8 * n)), n + 1
        bucket = ((code * U64(salt) ^ (code >> U64(20))) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)
        out.append((bucket.astype(np.int64), b.first, np.maximum(b.first, b.end - size + 1)))
    return out


def _logits(b: Block, model: dict) -> np.ndarray:
    z = np.full(len(b.first), model["bias"])
    for (bucket, s, e), w in zip(_features(b), model["weights"], strict=True):
        z += seg_sum(w[bucket], s, e) / np.maximum(e - s, 1)
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """a, b of sigmoid(a * z + b), by Newton steps with smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    mid, wide = z.mean(), max(z.std(), 1e-9)  # steps are taken on a scale of their own
    x = np.stack([(z - mid) / wide, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (t - p)) - 1e-3 * w * [1, 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def train(texts: list[str], y: np.ndarray, total: np.ndarray | None = None, rounds: int = 60, scale: float = 100.0) -> dict | None:
    """Weights of the three families, bias, and calibration; None without both classes.

    total: how many documents of each class there are, where the texts do not stand in that proportion.
    """
    sampled = y
    col, row, val, labels, n = [], [], [], [], 0
    for i in range(0, len(texts), 64):  # a few texts at a time: the driver holds their sparse rows only
        b = Block.of([t.encode("utf-8", "surrogatepass") for t in texts[i : i + 64]])
        passed = ~statistics(b)["base_failed"]
        at = n + np.cumsum(passed) - 1
        for f, (bucket, s, e) in enumerate(_features(b)):
            doc = np.repeat(np.arange(len(s)), e - s)
            key, count = np.unique((doc << BITS) | bucket[ragged(s, e - s)], return_counts=True)
            d = key >> BITS
            on = passed[d]
            row.append(at[d[on]].astype(np.int32))
            col.append(((key[on] & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32))
            val.append((count[on] / np.maximum(e - s, 1)[d[on]] * scale).astype(np.float32))
        labels.append(y[i : i + 64][passed])
        n += int(passed.sum())
    y = np.concatenate(labels) if labels else y
    if len(np.unique(y)) < 2:
        return None
    row, col, val = (np.concatenate(x) for x in (row, col, val))
    used, col = np.unique(col, return_inverse=True)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2:
        held[:] = False
    weight = np.where(held, 0.0, np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())))
    w, g2, bias, b2 = np.zeros(len(used)), np.full(len(used), 1e-10), 0.0, 1e-6
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], minlength=len(y)) + bias
        r = weight * (y - sigmoid(z))
        g = np.bincount(col, val * r[row], minlength=len(used)) - 1e-6 * w
        g2 += g * g
        w += 0.1 * g / np.sqrt(g2)
        b2 += r.sum() ** 2
        bias += 0.1 * r.sum() / np.sqrt(b2)
    z = np.bincount(row, val * w[col], minlength=len(y)) + bias
    on = held if held.any() else ~held
    # the share of each class that passes the base rule is the sample's; of the fold, each class stands for what passes
    passing = None if total is None else total * np.bincount(y, minlength=2) / np.maximum(np.bincount(sampled, minlength=2), 1)
    a, c = platt(z[on], y[on], class_weights(y[on], y[on], passing))
    weights = np.zeros(3 << BITS)
    weights[used] = w * scale * a
    return {"weights": list(weights.astype(np.float32).reshape(3, -1)), "bias": a * bias + c}


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row of COLUMNS for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for rb in blocks(batches):
            b = Block.of(raw_bytes(rb.column("text")))
            st = statistics(b)
            p = sigmoid(_logits(b, m)) if m else np.ones(len(b.first))
            kept = ~st["base_failed"] & (p >= threshold)
            counts = [pa.array(st[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *counts, pa.array(st["base_failed"]), pa.array(kept), pa.array(p)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return rows_of(docs).mapInArrow(run, COLUMNS)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    model = train(*labelled_sample(docs, labels, "quality", SAMPLE, SAMPLE_BYTES))
    tidy()
    return model


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay, decided row by row in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        m = model.value
        for rb in blocks(batches):
            b = Block.of(raw_bytes(rb.column("text")))
            keep = ~statistics(b)["base_failed"]
            if m:
                keep &= sigmoid(_logits(b, m)) >= THRESHOLD
            yield rb.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
