"""The closest choice by the whole text."""

import difflib

from chronoloom import catalog

KINDS = ["the quick answer", "no answer at all", "something else"]


def test_closest_benchmark_reads_whole_texts(spark, tmp_path):
    texts = ["the quick answer the quick answer the quick answer the quick " + "something else " * 30, "no answer at all " * 4 + "the quick answer " * 20, "x" * 70 + "something else", "short"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = lambda t: difflib.get_close_matches(t, KINDS, 1, 0.0)[0]
    want = {i: best(t) for i, t in enumerate(texts)}
    assert want != {i: best(t[:60]) for i, t in enumerate(texts)}
    assert dict(map(tuple, catalog.queries()["closest_benchmark"](spark, str(tmp_path)).collect())) == want
