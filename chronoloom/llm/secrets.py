"""Secret scans: exact patterns, and character Markov models of random and ordinary strings.

Base spans are the three patterns below, matched over whole texts, leftmost and non-overlapping per
kind; matches that fail their length are dropped.  The method adds spans of kind `markov`: runs of
token characters, clear of every base span, whose log-likelihood ratio of a first-order character
model of random strings against one of ordinary identifiers reaches a fixed bound in total and per
character.  Both models are trained from labelled samples: strings of a bounded sample of documents,
random where a base pattern marks them and ordinary elsewhere, and seeded random strings.

doc_id is returned as bigint.  A null text counts as empty and has no spans.  An empty table gives an
empty result.  Offsets are code points, ends exclusive.  Repeated rows
are scanned one by one.  Without any documents the ordinary model knows only the uniform prior.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_order, refit, rows_of, strings

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as filtering [0-9a-f]+ by length
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Strings the models judge, at least LEAST characters long.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
WORDS = re.compile(r"[A-Za-z0-9+/_.=-]{4,}")
#: Natural logs: total ratio, and mean ratio a character.
TOTAL, MEAN = 30.0, 0.8
#: Trained on at most SAMPLE documents, none over SAMPLE_BYTES bytes, and RANDOM seeded strings.
SAMPLE, SAMPLE_BYTES, RANDOM = 600, 20_000, 3000
SPANS = "array<struct<kind:string,start:int,end:int>>"
_CODE = np.full(128, 0, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]


def _model(samples: list[str]) -> np.ndarray:
    """Log transition probabilities between characters; state 0 stands before a string."""
    n = len(ALPHABET) + 1
    counts = np.full((n, n), 0.2)
    for s in samples:
        c = _codes(s)
        np.add.at(counts, (np.r_[0, c[:-1]], c), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def train(texts: list[str], seed: int = 11) -> np.ndarray:
    """Log-likelihood ratios of transitions, random over ordinary."""
    random, ordinary = [], []
    for t in texts:
        marked = base_spans(t)
        ordinary += [m.group() for m in WORDS.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b in marked)]
        random += [t[a:b].rpartition("=")[2].strip(" \"'") for a, k, b in marked if k]
    random = [s for s in random if s and s.isascii() and all(_CODE[ord(c)] for c in s)]
    rng = np.random.default_rng(seed)
    sets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    random += ["".join(np.array(list(sets[i % len(sets)]))[rng.integers(0, len(sets[i % len(sets)]), int(rng.integers(16, 65)))]) for i in range(RANDOM)]
    ordinary += [w.upper() for w in ordinary[::5]] + ["%d" % i for i in rng.integers(10**15, 10**16, 300)] + ["%d" % i for i in rng.integers(10**9, 10**10, 300)]
    return _model(random) - _model(ordinary)


def ratio(s: str, model: np.ndarray) -> float:
    c = _codes(s)
    return float(model[np.r_[0, c[:-1]], c].sum())


def find(text: str, model: np.ndarray | None) -> list[tuple[int, int, int]]:
    """All spans of a text in order of start, then kind."""
    spans = base_spans(text)
    if model is None:
        return spans
    more = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        core = s.strip("+/_.=-")
        if len(core) < LEAST:
            continue
        a = m.start() + s.index(core)
        b = a + len(core)
        if any(x < b and a < y for x, _, y in spans):
            continue
        r = ratio(core, model)
        if r >= TOTAL and r >= MEAN * len(core):
            more.append((a, 3, b))
    return sorted(spans + more)


def fit(docs: DataFrame) -> np.ndarray:
    got = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
        .orderBy(crc_order("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE).toArrow()
    )
    return train(got.column("text").to_pylist())


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and spans for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        m = held.value
        for rb in blocks(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t, m)] for t in strings(rb.column("text"))]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return rows_of(docs).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame, model: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); n_chars follows in its own type.  All columns stay, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str | None, m: np.ndarray) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, _, b in find(t, m):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join(out) + t[at:] if out else t

    def run(batches):
        for rb in blocks(batches):
            texts = [clean(t, held.value) for t in rb.column("text").to_pylist()]
            cols = [pa.array(texts, pa.string()) if n == "text" else refit(pa.array([None if t is None else len(t) for t in texts], pa.int64()), rb.column(n).type) if n == "n_chars" else rb.column(n) for n in rb.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names)

    return docs.mapInArrow(run, docs.schema)
