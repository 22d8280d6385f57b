"""Clusters, near duplicates, cycles, samples and graphs against plain versions on small tables."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from chronoloom.functions import frames
from chronoloom.operators import consolidate, facts, graph, models, neardup, retrieval, sampling, sequences, similarity


def test_band_choice():
    assert neardup.band_choice(0.7, 256) == (25, 10)
    b, r = neardup.band_choice(0.5, 32)
    assert b * r <= 32


def test_signature_by_definition():
    import hashlib

    text, (a, b) = "one two three four five six", neardup.permutations(16)
    grams = {"one two three four five", "two three four five six"}
    h = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams]
    want = [min(((x * int(p) + int(q)) % 2**64 if x * int(p) + int(q) >= 2**64 else x * int(p) + int(q)) % (2**61 - 1) & (2**32 - 1) for x in h) for p, q in zip(a, b, strict=True)]
    assert neardup.signature(text, 16).tolist() == want
    assert set(neardup.signature("too short", 16).tolist()) == {2**32 - 1} == set(neardup.signature(None, 16).tolist())


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base), (7, base + " more"), (8, " ".join(f"x{i}" for i in range(60))), (9, "a b"), (11, None), (12, "")]
    got = dict(map(tuple, neardup.clusters(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()))
    assert got == {1: 1, 5: 1, 7: 1, 8: 8, 9: 9, 11: 9, 12: 9}  # texts without an n-gram are one group
    kept = neardup.keep_roots(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert sorted(r["id"] for r in kept) == [1, 8, 9]
    empty = spark.createDataFrame([], "id long, text string")
    assert neardup.clusters(empty, "id", "text").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_matches_and_greedy(spark):
    r = np.random.RandomState(3)
    x = r.normal(size=(60, 4))
    rows = [(i, x[i].tolist(), int(r.randint(1, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, support int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    near = similarity.matches(df, df, "id", "v", 0.7)
    assert {(e["src"], e["dst"]) for e in near.collect()} == {(i, j) for i, j in itertools.permutations(range(60), 2) if s[i, j] >= 0.7}
    top = similarity.matches(df, df, "id", "v", None, 3)
    assert {(e["src"], e["dst"]) for e in top.collect()} == {(i, int(j)) for i in range(60) for j in [k for k in np.argsort(-s[i]) if k != i][:3]}
    want, free = {}, set(range(60))
    for i in sorted(range(60), key=lambda i: (-rows[i][2], i)):
        if i in free:
            took = {j for j in free if s[i, j] >= 0.7} | {i}
            want |= dict.fromkeys(took, i)
            free -= took
    got = dict(map(tuple, consolidate.greedy_clusters(df, near, "id", F.struct(-F.col("support"), F.col("id"))).collect()))
    assert got == want
    alone = dict(map(tuple, consolidate.greedy_clusters(df, near.limit(0), "id", F.struct("id")).collect()))
    assert alone == {i: i for i in range(60)}


def test_sleep_cycles(spark):
    t = [("I", "drink", "coffee", f"{n:02d}") for n in range(6)] + [("I", "drink", "coffee daily", "01"), ("Bob", "reads", "books", "03"), ("Bob", "reads", "books", "05")]
    df = spark.createDataFrame(t, "s string, p string, o string, node string")
    embed = lambda x: models.embed_distinct(x, "text", models.hashed_words)
    store, cycles = consolidate.sleep_cycles(df, embed, 0.8, 2, 100)
    got = {r["ko"]: (r["support"], r["first_seen"], r["last_seen"]) for r in store.collect()}
    assert got == {"coffee": (7, "00", "05"), "books": (2, "03", "05")} and cycles == 4
    whole, once = consolidate.sleep_cycles(df, embed, 0.8, 100, 100)
    assert once == 1 and {r["ko"]: r["support"] for r in whole.collect()} == {"coffee": 7, "books": 2}
    exact, _ = consolidate.sleep_cycles(df, embed, 1.01, 100, 2)  # at the cap a cycle runs at every node
    assert exact.count() == facts.fold_facts(df).count() == 3


def test_revise(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    new = spark.createDataFrame([(3, [1.0, 0.1])], "id long, v array<double>")
    assert sorted(r["id"] for r in consolidate.revise(old, new, "id", "v", lambda near: near).collect()) == [2, 3]


def test_samples(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    n = {r["k"]: r["_i"] for r in sampling.numbered(df, "k").collect()}
    assert n == {i: i for i in range(101)}
    assert sorted(r["k"] for r in sampling.even_sample(df, "k", 10).collect()) == [i * 101 // 10 for i in range(10)]
    assert sorted(r["k"] for r in sampling.stepped_sample(df, "k", 25).collect()) == list(range(0, 100, 4))
    assert sampling.even_sample(df.limit(0), "k", 5).count() == 0


def test_frames(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (95,)], "n int")
    got = [(r[0], r[1]) for r in df.select(frames.by_rate(F.col("n"), F.lit(29.97), 1.0), frames.by_count(F.col("n"), F.lit(4))).collect()]
    assert got == [([], []), ([0], [0]), ([0, 9], [0, 3, 6, 9]), ([0, 29, 58, 87, 94], [0, 31, 62, 94])]
    assert spark.range(1).select(frames.seconds(F.lit(1.5), F.lit(4.0))).first()[0] == [2, 3]


def test_anchored_windows_and_segments(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (7, 12, 16, 18, 25, 39)], "g int, t double")
    got = [r["window_start"] for r in sequences.anchored_windows(df, "g", "t", 10.0).orderBy("t").collect()]
    assert got == [7, 7, 7, 10, 20, 30]
    s = sequences.segments(spark.createDataFrame([(1, 5.0)], "g int, t double"), "g", "t", spark.createDataFrame([(1, 0.0, 9.0)], "g int, a double, b double"), "a", "b")
    assert sorted(map(tuple, s.collect())) == [(1, 0.0, 5.0), (1, 5.0, 9.0)]


def test_retrieval(spark):
    e = spark.createDataFrame([("p1", "cup", 1.0), ("p2", "pan", 1.0)], "passage string, entity string, w double").drop("w")
    f = spark.createDataFrame([("ann", "cup"), ("bob", "pan")], "s string, o string")
    none = spark.createDataFrame([], "src string, dst string, score double")
    g = graph.weighted_edges(f, e, none)
    passages = spark.createDataFrame([("p1", 0.0), ("p2", 1.0)], "passage string, score double")
    m = e.select("entity", F.col("passage").alias("chunk"))
    hot = spark.createDataFrame([("ann", "cup", 1.0)], "s string, o string, score double")
    assert [r["passage"] for r in retrieval.retrieve(g, hot, m, passages).collect()] == ["p1", "p2"]
    assert [r["passage"] for r in retrieval.retrieve(g, hot.limit(0), m, passages).collect()] == ["p2", "p1"]
    assert graph.graph_counts(f, e, none).first().asDict() == {"entities": 4, "passages": 2, "passage_edges": 2, "fact_edges": 2, "synonym_edges": 0}
    seen = passages.where("passage = 'p2'")
    assert [r["passage"] for r in retrieval.unseen(passages, seen, "passage", "score", 1).collect()] == ["p1"]
    c = spark.createDataFrame([(1, "cup", 1.0), (2, "cup", 0.9), (3, "pan", 0.95)], "id int, surface string, score double")
    assert sorted((r["id"], r["candidates"], round(r["margin"], 6)) for r in retrieval.same_surface(c, "surface", "score", "id").collect()) == [(1, 2, 0.1), (2, 2, 0.1)]
    late = spark.range(1).select(similarity.late_interaction(F.expr("array(array(1d, 0d), array(0d, 2d))"), F.expr("array(array(3d, 0d), array(1d, 1d))")))
    assert late.first()[0] == 5.0
