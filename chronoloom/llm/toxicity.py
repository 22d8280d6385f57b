"""Toxic spans by a linear-chain conditional random field, summed up to documents.

Token labels come from documents marked toxic or clean: a token is labelled toxic in a toxic document
if the word, or a prefix of 4 to 8 bytes, stands there in many different surroundings and hardly ever
in clean ones (different neighbours, so that copies of one document do not count as evidence).  The
field is fitted on stretches of those tokens.  The largest forward-backward marginal of a document and
the sum of those from 0.2 on go through a logistic curve, fitted on labelled documents that the field
has not seen, weighted to the classes' shares among all labelled ones; that is the score.

doc_id is returned as bigint.  An empty table gives an empty result.  A null text counts as empty; an empty text has the score of a document without any toxic token.
Repeated rows are scored one by one.  Without labelled documents of both classes the score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import U64, Roll, blocks, class_weights, labelled_sample, mix, rows_of, seg_sum, strings, tidy
from .quality import sigmoid

#: Fitted on at most SAMPLE documents of each class, none over SAMPLE_BYTES bytes.
SAMPLE, SAMPLE_BYTES = 1000, 8_000
THRESHOLD = 0.7
#: A word or prefix is evidence from so many different surroundings on, and at so many times the clean rate.
SUPPORT, LIFT = 4, 25
COLUMNS = "doc_id bigint, score double, predicted int, spans array<struct<start:int,end:int>>"
_TOKEN = re.compile(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+")


def _token_labels(tok: crf.Tokens, toxic: np.ndarray) -> np.ndarray:
    h, n = tok.hashes, len(tok.hashes)
    near = np.zeros(n, dtype=np.uint64)
    near[1:] = h[:-1]
    near[:-1] = mix(near[:-1] * U64(3) + h[1:])
    roll, length = Roll(tok.buf), tok.spans.e - tok.spans.s
    bad = np.zeros(n, dtype=bool)
    for size in (0, 4, 5, 6, 7, 8):
        on = np.flatnonzero(length >= size)
        key = h[on] if not size else roll.span(tok.spans.s[on], tok.spans.s[on] + size)
        _, key = np.unique(key, return_inverse=True)
        _, at = np.unique(mix(key.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + near[on]), return_index=True)
        t = np.bincount(key[at], toxic[on][at], minlength=key.max() + 1 if len(key) else 0)
        c = np.bincount(key[at], ~toxic[on][at], minlength=len(t))
        rate = t / max(1, toxic.sum()) / ((c + 0.5) / max(1, (~toxic).sum()))
        bad[on] |= ((t >= SUPPORT) & (rate >= LIFT))[key]
    return bad & toxic


def _summary(tok: crf.Tokens, p: np.ndarray) -> np.ndarray:
    """Of each text: the log odds of its most toxic token, the log of its toxic mass over 0.2, and 1."""
    s, e = tok.spans.at[:-1], tok.spans.at[1:]
    top = np.full(len(s), 1e-4)
    some = e > s
    if some.any():
        top[some] = np.maximum(top[some], np.maximum.reduceat(p, s[some]))
    top = np.minimum(top, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(seg_sum(np.where(p >= 0.2, p, 0), s, e)), np.ones(len(s))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.05 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], y: np.ndarray, total: np.ndarray | None = None, seed: int = 7, reach: int = 12) -> dict | None:
    """total: how many documents of each class there are, where the texts do not stand in that proportion."""
    if len(np.unique(y)) < 2:
        return None
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    tok = crf.Tokens.of([texts[i] for i in fit])
    toxic = (y[fit] == 1)[tok.spans.doc]
    bad = _token_labels(tok, toxic)
    # stretches around toxic tokens, and as long ones anywhere else
    rng = np.random.default_rng(seed)
    n = len(bad)
    spots = np.r_[np.flatnonzero(bad), rng.integers(0, max(n, 1), min(n, 6000))]
    near = np.zeros(n + 1, dtype=np.int64)
    np.add.at(near, np.maximum(spots - reach, 0), 1)
    np.subtract.at(near, np.minimum(spots + reach + 1, n), 1)
    order = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    if not len(order):
        return None
    starts = np.flatnonzero(np.r_[True, (np.diff(order) > 1) | (np.diff(tok.spans.doc[order]) > 0)])
    model = crf.train(tok, order, bad[order].astype(np.int64), starts, 2)
    on = np.flatnonzero(held) if held.any() else fit
    some = crf.Tokens.of([texts[i] for i in on])
    model["curve"] = _logistic(_summary(some, crf.marginals(some, model)[:, 1]), y[on], class_weights(y[on], y, total))
    return model


def assess(texts: list[str], model: dict | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores, and for each text at or over the threshold its offending spans (code points, end exclusive)."""
    if model is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    tok = crf.Tokens.of(texts)
    p = crf.marginals(tok, model)[:, 1]
    score = sigmoid(_summary(tok, p) @ model["curve"])
    spans: list[list[dict]] = []
    for i, t in enumerate(texts):
        found: list[dict] = []
        if score[i] >= THRESHOLD:
            q, k = p[tok.spans.at[i] : tok.spans.at[i + 1]], 0
            for m in _TOKEN.finditer(t):
                if any(c > "\x7f" or c.isalpha() for c in m.group()):
                    if k < len(q) and q[k] >= 0.5:
                        found.append({"start": m.start(), "end": m.end()})
                    k += 1
        spans.append(found)
    return score, spans


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from a bounded sample of labels (doc_id, toxic) and their docs (doc_id, text)."""
    model = train(*labelled_sample(docs, labels, "toxic", SAMPLE, SAMPLE_BYTES))
    tidy()
    return model


def tag(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row of COLUMNS for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        m = held.value
        for rb in blocks(batches):
            score, spans = assess(strings(rb.column("text")), m)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "spans"])

    return rows_of(docs).mapInArrow(run, COLUMNS)
