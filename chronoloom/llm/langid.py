"""Language identification by a linear-chain conditional random field over words.

Trained on words of texts whose language is known.  The texts are cut into runs of 4 to 40 words and
the runs of all texts are spliced in random order, so that the chain learns transitions between
languages from code-switched sequences.  Forward-backward gives each word's language; a text's
language is the one with the largest mean probability over its words, and that mean is the score.

doc_id is returned as bigint.  A null text, and one without a letter, is `und` with score 0.  Without any
training text everything is `und`.  An empty table gives an empty result.  Repeated rows are predicted one by one; ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import crf
from .common import blocks, crc_order, rows_of, seg_sum, strings, tidy

#: Fitted on SAMPLE texts evenly over all languages, LEAST of each at least, none over SAMPLE_BYTES bytes.
SAMPLE, LEAST, SAMPLE_BYTES = 1000, 16, 6_000
COLUMNS = "doc_id bigint, lang_pred string, score double"


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict | None:
    names = sorted(set(langs))
    tok = crf.Tokens.of(texts)
    if not len(tok.hashes):
        return None
    y = np.array([names.index(x) for x in langs])[tok.spans.doc]
    rng = np.random.default_rng(seed)
    cuts, i = [], 0
    for n in tok.spans.count:
        j = 0
        while j < n:
            m = int(min(n - j, rng.integers(4, 41)))
            cuts.append((i + j, m))
            j += m
        i += int(n)
    rng.shuffle(cuts)
    order = np.concatenate([np.arange(a, a + m) for a, m in cuts])
    ends = np.cumsum([m for _, m in cuts])
    starts = np.r_[0, ends[7:-1:8]]  # a chain for each eight runs
    return crf.train(tok, order, y[order], starts, len(names)) | {"names": names}


def predict(texts: list[str], model: dict | None) -> tuple[list[str], np.ndarray]:
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    tok = crf.Tokens.of(texts)
    p = seg_sum(crf.marginals(tok, model), tok.spans.at[:-1], tok.spans.at[1:]) / np.maximum(tok.spans.count, 1)[:, None]
    best = p.argmax(1)
    names = [model["names"][j] for j in best]
    score = np.clip(p[np.arange(len(texts)), best], 0, 1)
    for i, t in enumerate(texts):
        if not tok.spans.count[i] or not t.isascii() and not any(map(str.isalpha, t)):  # stops at the first letter
            names[i], score[i] = "und", 0.0
    return names, score


def word_labels(text: str, model: dict) -> list[tuple[str, str, float]]:
    """Words of one text with their language and its probability."""
    tok = crf.Tokens.of([text])
    p = crf.marginals(tok, model)
    raw = tok.buf.tobytes()
    return [(raw[s:e].decode("utf-8", "replace"), model["names"][int(q.argmax())], float(q.max())) for s, e, q in zip(tok.spans.s, tok.spans.e, p, strict=True)]


def fit(docs: DataFrame, learn: Column) -> dict | None:
    """A model from a bounded sample of docs (doc_id, text, lang) where learn is true."""
    known = rows_of(docs.where(learn), "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    langs = known.select("lang").distinct().count()
    if not langs:
        return None
    w = Window.partitionBy("lang").orderBy(crc_order("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(LEAST, -(-SAMPLE // langs))).select("lang", "doc_id").distinct()
    # one text of each chosen id: as many rows as the sample has
    got = known.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", crc_order("doc_id"), "doc_id").toArrow()
    model = train(got.column("text").to_pylist(), got.column("lang").to_pylist())
    tidy()
    return model


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row of COLUMNS for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for rb in blocks(batches):
            names, score = predict(strings(rb.column("text")), m)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return rows_of(docs).mapInArrow(run, COLUMNS)
