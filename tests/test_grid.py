"""Similarity joins in a grid of large cells."""

import numpy as np
import pytest

from chronoloom.operators import similarity


def test_grid_copies_little():
    """600,000 vectors of 64 numbers, as in 6 GB: blocks of 1024 copied each of them 586 times a side."""
    for n in (10_000, 100_000, 600_000):
        a, b = similarity._grid(n, n, 64, None)
        assert a * b >= similarity.CELLS and a + b <= 24 and n * 64 <= a * similarity.QUERIES and n * 64 <= b * similarity.ROWS



@pytest.mark.parametrize(("least", "top"), [(0.5, None), (0.2, 3), (None, 4), (None, None)])
def test_matches_in_many_cells(spark, monkeypatch, least, top):
    for name, v in (("QUERIES", 60), ("ROWS", 100), ("SCORES", 64)):
        monkeypatch.setattr(similarity, name, v)
    x = np.random.RandomState(8).normal(size=(50, 4)).astype("float32").astype(float)
    df = spark.createDataFrame([(f"{i:02d}", x[i].tolist()) for i in range(50)] + [("99", None)], "id string, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = set()
    for i in range(20):
        c = [j for j in np.argsort(-s[i], kind="stable") if j != i and (least is None or s[i, j] >= least)][:top]
        want |= {(f"{i:02d}", f"{j:02d}") for j in c}
    got = similarity.matches(df.where("id < '20'"), df, "id", "v", least, top).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
