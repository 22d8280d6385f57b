"""Signatures by the formula, in less time."""

import hashlib
import time

import numpy as np

from chronoloom.operators import neardup


def test_signature_is_quick():
    """The same numbers as the plain form of the formula, in well under its time."""

    def plain(text, perms=256):
        w, (a, b), out = neardup.SEPARATOR.split(text), neardup.permutations(perms), np.full(perms, neardup.MAX_HASH, dtype=np.uint64)
        h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}], dtype=np.uint64)
        p = np.uint64(neardup.PRIME)
        for i in range(0, len(h), 512):
            x = h[i : i + 512, None] * a + b
            x = (x & p) + (x >> np.uint64(61))
            np.minimum(out, (np.where(x >= p, x - p, x) & np.uint64(neardup.MAX_HASH)).min(axis=0), out=out)
        return out

    text, took = " ".join(f"w{i * i % 9973}" for i in range(8000)), {}
    assert plain(text).tolist() == neardup.signature(text).tolist()
    for f in (plain, neardup.signature):
        took[f] = []
        for _ in range(5):
            t = time.perf_counter()
            f(text)
            took[f].append(time.perf_counter() - t)
    assert min(took[neardup.signature]) < 0.8 * min(took[plain])
