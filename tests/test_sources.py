"""Sync files, artifacts, keyed stores, and functions without a query of their own."""

import json
import math

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.functions import vectors as V
from chronoloom.operators import evaluation, facts, filters, graph, joins, lexical, models, registry, reports, retrieval, sampling
from chronoloom.sources import artifacts, records, sync
from chronoloom.streaming import facts as stream
from chronoloom.streaming import sessions


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sync_files(spark, tmp_path):
    block = lambda *data: json.dumps([{"video_file": "v.mp4", "data": list(data)}])
    e = lambda s, t, text, **k: {"start": s, "end": t, "text": text, **k}
    (tmp_path / "A1_JAKE_DAY1_11000000.json").write_text(block(e("110500", "110600", " later "), e("110000", "110100", "first", type="transcript"), e("110000", "110030", "shorter"), e("116100", "116200", "bad minute"), e("110000", "110001", "   ")))
    (tmp_path / "A1_JAKE_DAY2_23000000.json").write_text(json.dumps([{"data": [e("235950", "000010", "midnight"), e("93000", "93010", "early"), {"start": "110000", "text": "no end"}]}]))
    (tmp_path / "A1_JAKE_DAY6_10000000.json").write_text(block(e("100000", "100001", "left out")))
    (tmp_path / "A2_OTHER_DAY1_10000000.json").write_text(block(e("100000", "100001", "someone else")))
    got = [tuple(r)[:4] for r in sync.read_sync(spark, str(tmp_path), "A1_JAKE", excluded=["DAY6"]).collect()]
    day = 86_400
    assert got == [(1, 39600, 39630, "shorter"), (1, 39600, 39660, "first"), (1, 39900, 39960, "later"), (2, day + 34200, day + 34210, "early"), (2, day + 86390, 2 * day + 10, "midnight")]
    assert [r["day"] for r in sync.read_sync(spark, str(tmp_path), "A1_JAKE", days=[6]).collect()] == [6]
    with pytest.raises(ValueError):
        filters.day_number("DAY")


def test_artifacts_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("I", "see", "cup", "n2"), ("i", "see", "Cup.", "n1"), ("me", "hold", "pen", "n3")], "s string, p string, o string, node string")
    f = facts.fold_facts(t)
    path = str(tmp_path / "store")
    for _ in range(2):  # a new version takes the old one's place
        artifacts.write_interval_store(f, path, threshold=0.86)
    rows, meta = artifacts.read_interval_store(spark, path)
    assert meta == {"format": "interval_v1", "threshold": 0.86} and sorted(map(str, rows.collect())) == sorted(map(str, f.collect()))
    artifacts.write_with_meta(f, path, {"format": "other"})
    with pytest.raises(ValueError):
        artifacts.read_interval_store(spark, path)
    bank = spark.createDataFrame([("ent-cup-0", "cup", "kitchen", 1, 9, 2, [1, 9])], "entity_id string, surface_form string, location_label string, first_seen bigint, last_seen bigint, n_mentions bigint, mention_times array<bigint>")
    artifacts.write_entity_bank(bank, str(tmp_path / "bank"))
    assert artifacts.read_entity_bank(spark, str(tmp_path / "bank")).collect() == bank.collect()
    chunks = spark.createDataFrame([(0.0, 30.0, "abcd"), (30.0, 45.0, "ab")], "start double, end double, text string")
    artifacts.write_chunks(chunks, str(tmp_path / "chunks"), {"strategy": "fixed"}, cuts=chunks.select("end"))
    got, meta = artifacts.read_with_meta(spark, str(tmp_path / "chunks/chunks"))
    assert meta == {"config": {"strategy": "fixed"}, "statistics": {"n_chunks": 2, "total_seconds": 45.0, "mean_text_chars": 3.0}} and got.count() == 2
    assert spark.read.parquet(str(tmp_path / "chunks/boundaries")).count() == 2


def test_checkpoint(spark, tmp_path):
    path = tmp_path / "log"
    c = artifacts.Checkpoint(spark, str(path), "ID", "ID string, response string")
    assert c.read().count() == 0
    rows = lambda *xs: spark.createDataFrame(list(xs), "ID string, response string")
    c.append(rows(("a", "old"), ("b", "x")), 0)
    c.append(rows(("a", "new")), 1)
    (path / "part-torn.json").write_text('{"ID":"c","response":"whole","_batch":1}\nnot json\n{"response":"no key","_batch":2}\n{"ID":"d","resp')
    want = [("a", "new"), ("b", "x"), ("c", "whole")]
    assert sorted(map(tuple, c.read().collect())) == want
    assert [r["ID"] for r in c.pending(rows(("a", ""), ("z", ""))).collect()] == ["z"]
    c.compact()
    assert sorted(map(tuple, c.read().collect())) == want and sum(len(p.read_text().splitlines()) for p in path.glob("*.json")) == 3
    c.append(rows(("b", "later")), 1)
    assert ("b", "later") in set(map(tuple, c.read().collect()))


def test_embedding_store(spark):
    store = spark.createDataFrame([], "id string, content string, vector array<double>")
    embed = lambda x: F.array(F.length(x).cast("double"))
    t = spark.createDataFrame([("cup",), ("cup",), ("pencil",)], "t string")
    one = artifacts.insert_strings(store, t, "t", embed)
    two = artifacts.insert_strings(one, spark.createDataFrame([("cup",), ("pan",)], "t string"), "t", embed)
    assert sorted((r["content"], r["vector"]) for r in two.collect()) == [("cup", [3.0]), ("pan", [3.0]), ("pencil", [6.0])]
    assert artifacts.delete_ids(two, one.select("id")).select("content").collect()[0][0] == "pan"
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(map(tuple, records.insert_missing(a, spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string"), "k").collect())) == [(1, "x"), (2, "z")]


def test_lexical_score_in_plain_python(spark):
    import re

    bank = [("e1", "hat", "living_room", 3), ("e2", "blue hat", "kitchen", 1), ("e3", "what", "desk", 9), ("e4", "hat box", "garden", 40), ("e5", "?", "desk", 2), ("e6", "hat", "desk", 3)]
    words = lambda t: re.findall(r"[a-z0-9']+", t.lower())

    def has(q, p):
        return bool(p) and any(q[i : i + len(p)] == p for i in range(len(q)))

    for query in ("Where is my blue hat in the living room?", "what", "nothing shared", "the HAT on the desk"):
        q, want = words(query), {}
        for key, surface, place, n in bank:
            s = words(surface)
            share = len(set(s) & set(q))
            base = (1.0 if len(set(s)) > 1 else 0.9) if has(q, s) else 0.75 * share / len(set(s)) if share else None
            if base:
                want[key] = base * (1 + 0.08 * math.log1p(n)) * (1.25 if has(q, words(place.replace("_", " "))) else 1)
        df = spark.createDataFrame(bank, "entity_id string, surface string, location string, n int")
        got = [(r["entity_id"], round(r["score"], 9)) for r in lexical.lexical_rank(df, "entity_id", "surface", "n", "location", query, 10).collect()]
        assert got == sorted(((k, round(v / max(want.values()), 9)) for k, v in want.items()), key=lambda x: (-x[1], x[0]))
    ask = spark.range(1).select(lexical.which_one(F.lit("cup"), F.array(F.lit("living_room"), F.lit("desk"), F.lit("desk"))).alias("a"), lexical.which_one(F.lit("cup"), F.array(F.lit("desk"))).alias("b"), lexical.display(F.lit("e"), F.lit("cup"), F.lit("living_room"), F.lit(2)).alias("c")).first()
    assert ask["a"] == "Which cup do you mean: the one at living room or desk?" and ask["b"] is None and ask["c"] == "e: cup (living room, 2 mentions)"


def test_choices(spark):
    said = ["A", "(b) two", "C.", "the answer is (C)", "two.", "B. two", "(B) TWO", "I cannot answer this question", "", None, "Z"]
    assert column(spark, said, T.first_letter) == ["A", "B", "C", "T", "T", "B", "B", "I", None, None, "Z"]
    right = column(spark, said, lambda x: T.right_choice(x, F.lit("B"), F.lit("Two"), T.choice_letter(x)))
    assert right == [False, True, False, False, True, True, True, False, False, False, False]
    assert column(spark, ["A. one", "B) two", "E. no"], T.strip_option) == ["one", "two", "E. no"]
    assert [tuple(x) for x in column(spark, [["Me", "see"], ["The Cup.", "is", "Red"], []], T.canonical_key, "array<string>")] == [("i", "see", ""), ("cup", "is", "red"), ("", "", "")]
    assert column(spark, [[["a", "b", "c"], ["a", "b"], ["a", "b", "c"]]], T.valid_triples, "array<array<string>>") == [[["a", "b", "c"]]]
    z = spark.sql("select array(array('a','b','c'), array('x')) as t, array('one', 'two') as e").select(T.aligned(F.col("t"), F.col("e")).alias("z")).first()["z"]
    assert [(x["triple"], x["evidence"]) for x in z] == [(["a", "b", "c"], "one")]
    phrases = spark.createDataFrame([("what hat", "hat", True), ("what", "hat", False), ("a b c", "b c", True), ("a", "", False)], "a string, b string, want boolean")
    assert phrases.where(T.has_phrase(T.tokens(F.col("a")), T.tokens(F.col("b"))) != F.col("want")).isEmpty()
    assert column(spark, [11094208, 235959, 0], lambda x: K.seconds_frame_clock(K.frame_clock_seconds(x)), "bigint") == [11094200, 235900, 0]


def test_answers_and_grades(spark):
    df = spark.createDataFrame([("the cat sat", ["A cat sat.", "dog"]), ("a b b", ["b b b c"]), ("", ["x"]), ("x", [])], "p string, g array<string>")
    em, f1 = evaluation.answer_scores(F.col("p"), F.col("g"))
    assert [(r[0], round(r[1], 6)) for r in df.select(em, f1).collect()] == [(1.0, 1.0), (0.0, round(2 * 2 / 6, 6)), (0.0, 0.0), (0.0, 0.0)]
    grades = [3, 2, 3, 0, 1, 2]
    dcg = lambda xs: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(xs[:4]))
    got = column(spark, [grades, [0, 0], []], lambda x: evaluation.exponential_ndcg(x, 4), "array<int>")
    assert got == pytest.approx([dcg(grades) / dcg(sorted(grades, reverse=True)), 0.0, 0.0])


def test_small_operators(spark):
    files = spark.createDataFrame([("a/x.srt",), ("b/y.srt",), ("c/none.srt",)], "path string")
    videos = spark.createDataFrame([("a/x.mp4",), ("z/x.mp4",), ("q/y.mp4",), ("r/y.mp4",)], "video string")
    assert {r["path"]: r["video"] for r in joins.by_path_or_stem(files, videos.withColumnRenamed("video", "v"), "path", "v").collect()} == {"a/x.srt": "a/x.mp4", "b/y.srt": "q/y.mp4", "c/none.srt": None}
    assert column(spark, [{"A": "x", "B": "", "C": None}], filters.filled_choices, "map<string,string>") == [{"A": "x"}]
    raw, est = reports.vector_bytes(F.lit(10), F.lit(4), F.lit(320.0), F.lit(10))
    assert tuple(spark.range(1).select(raw, est).first()) == (160, 320)
    seeds = spark.createDataFrame([("a", 0.5), ("lone", 0.5)], "node string, weight double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    r = {x["node"]: x["rank"] for x in graph.pagerank(edges, seeds, 0.85, 120).collect()}
    assert sum(r.values()) == pytest.approx(1.0) and r["lone"] == pytest.approx(0.5 * 0.15 / (1 - 0.85 * 0.5 - 0.0) , rel=1e-6)
    ranked = retrieval.triple_scores(spark.createDataFrame([("a", "b"), ("a", "zz")], "s string, o string"), spark.createDataFrame([("a", 1.0), ("b", 0.5)], "node string, rank double"))
    assert sorted(x["score"] for x in ranked.collect()) == [1.0, 1.5]
    clips = spark.createDataFrame([(0, 10), (10, 20), (30, 40)], "start_time int, end_time int")
    assert retrieval.by_time_range(clips, 10, 29).count() == 2
    assert [x["id"] for x in sampling.stride_shard(spark.range(7), F.col("id"), 3, 1).collect()] == [1, 4]
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    assert {x["id"]: x["score"] for x in retrieval.dense_rank(p, "v", [1.0, 0.0]).collect()} == {1: 1.0, 2: 0.0}
    assert column(spark, [3.0, 1.0, 2.0], V.min_max, "double") == [1.0, 0.0, 0.5]


def test_registry(spark):
    e = spark.createDataFrame([("p", "f1", 0.0), ("p", "f2", 30.0), ("p", "f3", 500.0)], "person string, file string, start double")
    assert sorted(r["chunk"] for r in registry.CHUNKING["fixed"](e, window_seconds=60).collect()) == [0, 0, 1]
    assert sorted(r["chunk"] for r in registry.CHUNKING["gap"](e).collect()) == [0, 0, 1]
    with pytest.raises(KeyError, match="fixed"):
        registry.CHUNKING["unknown"]
    with pytest.raises(ValueError):
        registry.MODELS.add("echo")(len)
    assert registry.model("constant", reply="x")(["a", "b"]) == ["x", "x"]
    assert registry.aggregate(e, ["person"], "start", "max").first()["start"] == 500.0
    assert [len(b) for b in registry.LOADERS["rows"](e, 2, "start")] == [2, 1]


def test_models_that_misbehave(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")

    def short(prompts):  # replies get lost in batches
        return [p.upper() for p in prompts][: 1 if len(prompts) > 1 else None]

    assert sorted((r["q"], r["response"], r["error"]) for r in models.complete(df, "q", short).collect()) == [("a", "A", None), ("b", "B", None), ("c", "C", None)]

    def learns(prompts):
        return ['{"x": 1}' if "valid JSON" in p or p == "a" else "no json" for p in prompts]

    assert sorted((r["q"], r["value"], r["attempts"]) for r in models.structured(df, "q", learns, "x").collect()) == [("a", "1", 1), ("b", "1", 2), ("c", "1", 2)]


def test_streams(spark, tmp_path):
    """Session windows on a stream give what the batch gives; late rows go to a side table; compacted batches count once."""
    src = tmp_path / "in"
    rows = [(u, f"2024-01-01 00:{m:02d}:00", float(m)) for u in (1, 2) for m in (0, 1, 2, 20, 21)] + [(9, "2024-01-03 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(src))
    live = sessions.activity_sessions(spark.readStream.schema(df.schema).parquet(str(src)), "5 minutes", late="1 minute")
    q = live.writeStream.format("memory").queryName("live_sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    want = {tuple(r) for r in sessions.activity_sessions(df, "5 minutes").collect() if r["user_id"] != 9}
    assert {tuple(r) for r in spark.table("live_sessions").collect()} == want and len(want) == 4

    put = stream.route_late(str(tmp_path / "on"), str(tmp_path / "late"))
    put(spark.createDataFrame([(1, 0, False), (2, None, True)], "id int, node long, late boolean"), 0)
    assert spark.read.parquet(str(tmp_path / "on/batch=0")).select("id").collect()[0][0] == 1 and spark.read.parquet(str(tmp_path / "late/batch=0")).collect()[0]["id"] == 2

    t = spark.createDataFrame([("I", "see", "cup", "n1")], "s string, p string, o string, node string")
    path = str(tmp_path / "facts")
    fold = stream.fold_batches(path)
    for n in range(3):
        fold(t, n)
    stream.compact(spark, path, 1)
    assert sorted(p.name for p in (tmp_path / "facts").iterdir() if p.name.startswith("batch")) == ["batch=-2", "batch=2"]
    fold(t, 3)
    stream.compact(spark, path, 2)
    assert stream.stored_facts(spark, path).first()["support"] == 4
