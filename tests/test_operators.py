"""Invariants of single operators on small tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.operators import evaluation, facts, sequences
from chronoloom.sources import records, subtitles
from chronoloom.streaming import sessions


def one(spark, df_rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(df_rows, schema).select(*cols).collect()]


def test_time_keys(spark):
    got = one(spark, [("112345629",), ("199999999",), ("8300000",)], "k string", K.key_seconds(F.col("k")), K.human(F.col("k")))
    assert got[0] == (12 * 3600 + 34 * 60 + 56 + 29 / 30, "DAY1 12:34:56") and got[1] == (None, None) and got[2][0] is None
    assert one(spark, [(59.99999,)], "s double", K.seconds_key(F.col("s"))) == [("100010000",)]
    assert one(spark, [("250000",), ("6000",)], "c string", K.clock_seconds(F.col("c"))) == [(90000,), (None,)]


def test_choice_letters(spark):
    cases = [(r"Final Answer: $\boxed{A}$", "A"), ("(C)", "C"), ("I cannot answer this question.", None), ("The answer is E.", None), ("so it must be B.", "B"), ("**D** because", "D")]
    assert one(spark, [(a,) for a, _ in cases], "t string", T.choice_letter(F.col("t"))) == [(b,) for _, b in cases]


def test_text_forms(spark):
    got = one(spark, [("  The  red, cup. ",), ("Myself",), ("my the Knife",)], "t string", T.normalise_text(F.col("t")), T.fold(F.col("t")), T.surface_form(F.col("t")))
    assert got == [("red, cup", "red, cup", "red cup"), ("Myself", "i", "myself"), ("my the Knife", "my the knife", "knife")]
    assert one(spark, [("in the kitchen",), ("kitchen then bedroom",)], "t string", T.location_cue(F.col("t"))) == [("kitchen",), (None,)]


def test_routine_is_one_fact(spark):
    t = spark.createDataFrame([("I", "drink", "coffee", f"{d}08000000") for d in range(1, 8)] + [("", "is", "x", "1"), ("I", "like running", "", "2")], "s string, p string, o string, node string")
    f = {r["ko"]: r for r in facts.fold_facts(t).collect()}
    assert f["coffee"]["support"] == 7 and f["coffee"]["first_seen"] == "108000000" and f["coffee"]["last_seen"] == "708000000" and "" in f and len(f) == 2


def test_cuts():
    t = np.arange(0, 100.0)
    z, d = np.zeros(100), np.ones(100)
    z[[30, 33, 60]] = 5, 9, 7
    got = sequences.cut(t, z, d, np.zeros(100, bool), 3, 0.5, 10, 40)
    assert [c for c, _ in got] == [33, 60] and all(o == "detected" for _, o in got)
    capped = sequences.cut(t, np.zeros(100), d, np.zeros(100, bool), 3, 0.5, 10, 40)
    assert all(b - a <= 40 for a, b in zip([0, *[c for c, _ in capped]], [*[c for c, _ in capped], 99], strict=True))
    gap = np.zeros(100, bool)
    gap[50] = True
    assert (50.0, "gap") in sequences.cut(t, np.zeros(100), d, gap, 3, 0.5, 10, 400)


def test_carry_forward(spark):
    rows = [(1, i, x) for i, x in enumerate([["a"], [], [], [], ["a", "b"], [], ["b"], []])]
    df = spark.createDataFrame(rows, "g int, i int, l array<string>")
    got = [r["carried"] for r in sequences.carry_forward(df, "g", "i", F.col("l"), 2).orderBy("i").collect()]
    assert got == ["a", "a", "a", None, None, None, "b", "b"]


def test_mcnemar(spark):
    b, c = 3, 9
    want = min(1, 2 * sum(math.comb(12, i) for i in range(4)) / 2**12)
    got = one(spark, [(b, c), (0, 0), (4000, 4000)], "b long, c long", evaluation.mcnemar(F.col("b"), F.col("c")))
    assert abs(got[0][0] - want) < 1e-12 and got[1][0] == 1 and got[2][0] == 1


def test_confidence(spark):
    cases = [(1, 0.0, 1.0), (0, 0.0, 1.0), (2, 0.0, 0.0), (2, 0.2, 1.0), (2, 10.0, 1.0), (2, -0.5, 0.0)]
    assert one(spark, [c[:2] for c in cases], "n int, m double", evaluation.confidence(F.col("n"), F.col("m"))) == [(c[2],) for c in cases]


def test_subtitles(spark, tmp_path):
    cues = spark.createDataFrame([("v", 0.0, 1.5, "Hello there"), ("v", 3661.0, 3662.25, " two "), ("v", 5.0, 6.0, "  ")], "file string, start double, end double, text string")
    text = subtitles.srt_text(cues, "file").first()["srt"]
    assert "01:01:01,000 --> 01:01:02,250" in text and text.startswith("1\n")
    (tmp_path / "a.srt").write_text(text)
    back = subtitles.read_srt(spark, str(tmp_path / "a.srt")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in back] == [(0.0, 1.5, "Hello there"), (3661.0, 3662.25, "two")]


def test_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"key":"a","n":1}\n{"key":"a","n":2}\n{"key":"b","n":3}\n{"key":"c","n"')
    got = records.last_wins(records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "key string, n int"), "key", F.col("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {"a": 2, "b": 3}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = sessions.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "1 day", "365 days")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, sessions.windowed_counts(e, "1 day").collect()))


def test_core_without_training_operators():
    import ast
    from pathlib import Path

    import chronoloom

    root = Path(chronoloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p
