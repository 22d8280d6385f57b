"""Linear-chain conditional random field over word tokens, trained and applied in numpy.

A token's emission is the sum of hashed features: its byte n-grams of 2 to 5 with the boundary before
and after it (so affixes are among them) and, for words of the trained lexicon, a weight of the whole
word.  Forward-backward runs over all tokens of a block at once: the chain is cut into equal pieces,
every piece's transfer matrix is built step by step for all pieces together, the pieces are linked,
and the messages inside the pieces follow in parallel.  It is exact and costs no loop over texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import LETTER, PUNCT, U64, Roll, Spans, ragged, text_block

BITS = 18
GRAMS = {2: 0xA24BAED4963EE407, 3: 0x9FB21C651E98DF25, 4: 0xC2B2AE3D27D4EB4F, 5: 0x165667B19E3779F9}


@dataclass
class Tokens:
    """Tokens of lower-cased texts: runs of letters and digits (and any byte over 127) with a letter."""

    buf: np.ndarray
    spans: Spans
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        buf, first, end = text_block([t.lower().encode("utf-8", "surrogatepass") for t in texts])
        spans = Spans(buf, first, end, PUNCT)
        letters = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(LETTER[buf], out=letters[1:])
        spans.keep(letters[spans.e] > letters[spans.s], first)
        return cls(buf, spans, Roll(buf).span(spans.s, spans.e))


def gram_buckets(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket arrays, one for each n, over the places of all tokens; and where each token's places start.

    A place is a token's byte or the boundary before it; windows that pass the boundary after the token
    have the bucket 1 << BITS, whose weight is 0.
    """
    n = e - s + 1
    at = ragged(s - 1, n)
    left = np.repeat(e, n) - at
    clean = np.where(PUNCT[buf], 32, buf).astype(np.uint64)
    clean = np.concatenate([clean, np.full(5, 32, dtype=np.uint64)])
    out, code, size = [], clean[at], 1
    for g, salt in GRAMS.items():
        while size < g:
            code, size = code | (clean[at + size] << U64(8 * size)), size + 1
        b = (((code * U64(salt)) ^ (code >> U64(20))) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)
        out.append(np.where(left >= g - 1, b.astype(np.int64), 1 << BITS))
    return out, np.cumsum(n) - n


def _sums(weights: np.ndarray, grams: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, weights.shape[1]), dtype=weights.dtype)
    x = weights[grams[0]]
    for g in grams[1:]:
        x += weights[g]
    return np.add.reduceat(x, starts, axis=0)


def _rows(x: np.ndarray) -> np.ndarray:
    """Row sums as a column, at least a tiny positive number."""
    t = x[:, 0].copy()
    for j in range(1, x.shape[1]):
        t += x[:, j]
    return np.maximum(t, 1e-300)[:, None]


def _scan(e: np.ndarray, a: np.ndarray, init: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """x[t] = e[t] * (x[t-1] @ a), or e[t] * init where reset[t]; each row scaled to sum 1."""
    t, k = e.shape
    size = max(16, int(np.sqrt(t) / 2))
    n = -(-t // size)
    pad = n * size - t
    e = np.concatenate([e, np.ones((pad, k), dtype=e.dtype)]).reshape(n, size, k)
    reset = np.concatenate([reset, np.ones(pad, dtype=bool)]).reshape(n, size)
    m = np.broadcast_to(np.eye(k, dtype=e.dtype), (n, k, k)).copy()
    for i in range(size):
        step = m @ a
        r = reset[:, i]
        if r.any():
            step[r] = m[r].sum(2, keepdims=True) * init
        m = step * e[:, None, i, :]
        m /= np.maximum(m.sum((1, 2), keepdims=True), 1e-300)
    x = np.empty((n, k), dtype=e.dtype)
    now = init / init.sum()
    for i in range(n):
        x[i] = now
        now = now @ m[i]
        now = now / max(now.sum(), 1e-300)
    out = np.empty_like(e)
    for i in range(size):
        step = x @ a
        r = reset[:, i]
        if r.any():
            step[r] = init
        x = step * e[:, i]
        x /= _rows(x)
        out[:, i] = x
    return out.reshape(n * size, k)[:t]


def messages(logits: np.ndarray, trans: np.ndarray, init: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages, backward messages times emissions, emissions, and the marginals of every token."""
    t, k = logits.shape
    top = logits[:, 0].copy()
    for j in range(1, k):  # columns: numpy is slow along short rows
        np.maximum(top, logits[:, j], out=top)
    e = np.exp(np.maximum(logits - top[:, None], -60))
    a, first = np.exp(trans), np.exp(init)
    reset = np.zeros(t, dtype=bool)
    reset[starts] = True
    fore = _scan(e, a, first, reset)
    back = _scan(e[::-1], a.T, np.ones(k), np.r_[reset[1:], True][::-1])[::-1]
    g = fore * back / e
    g /= _rows(g)
    return fore, back, e, g


def marginals(tok: Tokens, model: dict) -> np.ndarray:
    """Probability of each label for each token; chains start with each text."""
    s, e = tok.spans.s, tok.spans.e
    if not len(s):
        return np.zeros((0, len(model["init"])))
    uniq, first, inverse = np.unique(tok.hashes, return_index=True, return_inverse=True)  # each word's emission once
    grams, at = gram_buckets(tok.buf, s[first], e[first])
    x = _sums(model["grams"], grams, at).astype(np.float64) + model["bias"]
    lex = model["lexicon"]
    if len(lex):
        i = np.minimum(np.searchsorted(lex, uniq), len(lex) - 1)
        hit = lex[i] == uniq
        x[hit] += model["words"][i[hit]]
    return messages(x[inverse], model["trans"], model["init"], tok.spans.at[:-1][tok.spans.count > 0])[3]


def train(tok: Tokens, order: np.ndarray, labels: np.ndarray, starts: np.ndarray, k: int, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, least: int = 3) -> dict:
    """Fit to the token sequence tok[order] with its labels; chains begin at starts.

    Words seen at least `least` times have weights of their own.
    """
    uniq, first, inverse, count = np.unique(tok.hashes, return_index=True, return_inverse=True, return_counts=True)
    grams, at = gram_buckets(tok.buf, tok.spans.s[first], tok.spans.e[first])
    reps = np.diff(np.r_[at, len(grams[0])])
    often = np.flatnonzero(count >= least)
    inv = inverse[order]
    y = np.zeros((len(order), k))
    y[np.arange(len(order)), labels] = 1
    inner = np.ones(len(order), dtype=bool)
    inner[starts] = False
    at2 = np.flatnonzero(inner)
    pairs = np.bincount(labels[at2 - 1] * k + labels[at2], minlength=k * k).reshape(k, k)
    firsts = np.bincount(labels[starts], minlength=k)
    used, cols = np.unique(np.concatenate(grams), return_inverse=True)
    cols = np.split(cols, len(grams))
    w = {"grams": np.zeros((len(used), k)), "words": np.zeros((len(often), k)), "trans": np.zeros((k, k)), "init": np.zeros(k), "bias": np.zeros(k)}
    g2 = {n: np.full(x.shape, 1e-8) for n, x in w.items()}
    null = used == 1 << BITS
    n = max(1, len(order))
    for _ in range(rounds):
        x = _sums(w["grams"], cols, at) + w["bias"]
        x[often] += w["words"]
        fore, back, _, g = messages(x[inv], w["trans"], w["init"], starts)
        xi = fore[at2 - 1][:, :, None] * np.exp(w["trans"]) * back[at2][:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        r = y - g
        rw = np.stack([np.bincount(inv, r[:, j], minlength=len(uniq)) for j in range(k)], 1)
        rp = np.repeat(rw, reps, axis=0)
        grad = {
            "grams": np.stack([sum(np.bincount(c, rp[:, j], minlength=len(used)) for c in cols) for j in range(k)], 1),
            "words": rw[often], "trans": pairs - xi.sum(0), "init": firsts - g[starts].sum(0), "bias": rw.sum(0),
        }
        for name in w:
            d = grad[name] / n - decay * w[name] / (100 if name in ("trans", "init", "bias") else 1)
            g2[name] += d * d
            w[name] += rate * d / np.sqrt(g2[name])
        w["grams"][null] = 0
    full = np.zeros(((1 << BITS) + 1, k), dtype=np.float32)
    full[used] = w["grams"]
    full[1 << BITS] = 0
    return {"grams": full, "lexicon": uniq[often], "words": w["words"], "trans": w["trans"], "init": w["init"], "bias": w["bias"]}
