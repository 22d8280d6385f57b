"""Replies, injected models, the question loop and file sources."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import jsonfix
from chronoloom.functions import textnorm as T
from chronoloom.functions import timekeys as K
from chronoloom.operators import agent, models
from chronoloom.sources import captions


@pytest.mark.parametrize(
    ("text", "value", "how"),
    [
        ('{"a": 1}', {"a": 1}, "clean"), ("```json\n{\"a\": [1, 2,],}\n```", {"a": [1, 2]}, "fenced"), ('Here: {"a": "x}"} thanks', {"a": "x}"}, "sliced"), ('{"a": [["x", "y", "z"], ["p", "q', {"a": [["x", "y", "z"], ["p"]]}, "repaired"),
        ('{"a": 1, // note\n "b": 2}', {"a": 1, "b": 2}, "fenced"), ("nothing", None, "failed"), ("", None, "failed"), (None, None, "failed"),
    ],
)
def test_salvage(text, value, how):
    assert jsonfix.salvage(text) == (value, how)


@pytest.mark.parametrize(
    ("value", "fields", "want"),
    [
        (["x"], ["e"], {"e": ["x"]}), ({"names": ["x", None]}, ["e"], {"e": ["x", ""]}), ({"e": [{"type": "p", "name": "Ann"}, {"q": "Bob"}, {}]}, ["e"], {"e": ["Ann", "Bob", ""]}),
        ({"t": [["a", None, ["b", ["c", "d"]]]]}, ["t"], {"t": [["a", "", "b c d"]]}), ({"n": [1, 2]}, ["n"], {"n": [1, 2]}), ("text", ["e"], "text"), ({"a": 1, "b": 2}, ["e"], {"a": 1, "b": 2}),
    ],
)
def test_coerce(value, fields, want):
    assert jsonfix.coerce(value, fields) == want


def test_reply_columns(spark):
    df = spark.createDataFrame([('So {"decision": "search", "selected_memory": {"memory_type": "episodic", "search_query": "cup"}} ok',), ("plain",)], "r string")
    got = [r[0].asDict(True) for r in df.select(jsonfix.reasoning_reply(F.col("r"))).collect()]
    assert got[0] == {"decision": "search", "selected_memory": {"memory_type": "episodic", "search_query": "cup"}} and got[1]["decision"] == "answer"
    c = spark.createDataFrame([("cupp", ["cup", "pan"]), (None, ["pan"]), ("x", None), ("x", [])], "t string, c array<string>")
    assert [r[0] for r in c.select(jsonfix.closest(F.col("t"), F.col("c"))).collect()] == ["cup", "pan", None, None]
    with pytest.raises(KeyError):
        jsonfix.template("{a} {b}")(a=F.lit(1))


def _ner(texts):
    return [json.dumps({"named_entities": [w for w in t.split() if w.istitle()]}) for t in texts]


def _relations(texts):
    if any("broken" in t for t in texts):
        raise RuntimeError("down")
    return ["```\n" + json.dumps([[n, "is in", "text"] for n in json.loads(t)["named_entities"]] + [["too", "short"]]) + "\n```" for t in texts]


def test_extraction(spark):
    df = spark.createDataFrame([(1, "Ann met Bob"), (2, "Ann met Bob"), (3, "broken Cat"), (4, ""), (5, None)], "id int, text string")
    got = {r["id"]: r for r in models.extract_triples(df, "id", "text", _ner, _relations).collect()}
    assert len(got) == 5 and got[1]["triples"] == got[2]["triples"] == [["Ann", "is in", "text"], ["Bob", "is in", "text"]]
    assert got[3]["triples"] == [] and got[3]["how"] == "error: RuntimeError" and got[3]["entities"] == ["Cat"] and got[4]["how"] == got[5]["how"] == "empty"


def test_complete_and_embed(spark):
    def shout(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a"), (4, None)], "id int, t string")
    got = {r["id"]: (r["response"], r["error"]) for r in models.complete(df, "t", shout).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("A", None), 4: ("", None)}
    v = {r["id"]: r["vec"] for r in models.embed_distinct(df, "t", models.hashed_words).collect()}
    assert v[1] == v[3] != v[2] and v[4] is None and np.allclose(v[1], models.hashed_words(["a"])[0])


def test_summaries(spark):
    df = spark.createDataFrame([("d", float(t), i, f"e{i}") for i, t in enumerate((3, 8, 14, 21))], "day string, t double, i int, text string")
    got = {(r["level"], r["start"]): r["text"] for r in models.summaries(df, "day", "t", "i", "text", [10.0, 100.0], lambda p: ["<" + x.replace("\n", "+") + ">" for x in p]).collect()}
    assert got == {(0, 3.0): "<e0+e1>", (0, 10.0): "<e2>", (0, 20.0): "<e3>", (1, 3.0): "<<e0+e1>+<e2>+<e3>>"}


def test_question_loop(spark):
    store = spark.createDataFrame([("a", "cup on desk", "1"), ("b", "cup in kitchen", "2"), ("c", "later", "9")], "id string, text string, end_time string")

    def search(query, until, seen):
        return store.where((F.col("end_time") <= until) & F.col("text").contains(query) & ~F.col("id").isin(*seen, "")).orderBy("id").limit(1)

    def reason(prompt):
        h = json.loads(prompt)["history"]
        return json.dumps({"decision": "search", "selected_memory": {"memory_type": ["none", "episodic", "episodic", "episodic"][len(h)], "search_query": "cup"}}) if len(h) < 4 else "enough"

    got = agent.ask("where?", "5", {"episodic": search}, reason, lambda p: str(len(json.loads(p)["history"])))
    assert got.answer == "4" and got.errors == 1 and [r.get("found") for r in got.rounds] == [None, ["cup on desk"], ["cup in kitchen"], []]
    assert len(agent.ask("where?", "5", {"episodic": search}, reason, lambda p: "x", rounds=2).rounds) == 2
    shy = agent.ask("where?", "5", {}, reason, lambda p: "x", gate=lambda q, u: (0.1, 3))
    assert shy.abstained and shy.answer is None and not agent.ask("?", "5", {}, lambda p: "", lambda p: "x", gate=lambda q, u: (0.1, 1)).abstained


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir(), (tmp_path / "z").mkdir()
    (tmp_path / "j/a.json").write_text('[{"text": "one", "n": 1}, {"text": "two"}]')
    assert [(r["pos"], r["text"], r["n"]) for r in captions.read_arrays(spark, str(tmp_path / "j"), "text string, n int").orderBy("pos").collect()] == [(0, "one", 1), (1, "two", None)]
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w") as z:
        z.writestr("m.json", '[{"text": "in zip"}]'), z.writestr("bad.json", "[")
    (tmp_path / "z/b.zip").write_bytes(b"not a zip")
    assert [(r["member"], r["text"]) for r in captions.read_zipped(spark, str(tmp_path / "z"), "text string").collect()] == [("m.json", "in zip")]
    (tmp_path / "d.jsonl").write_text('{"custom_id": "x-y-100-200", "translated_text": "hi"}\n{"custom_id": "bad", "translated_text": "no"}\n')
    assert [tuple(r) for r in captions.dense_captions(spark, str(tmp_path / "d.jsonl")).collect()] == [(100, 200, "hi", "caption")]
    nested = json.dumps({"11": {"semantic_triples": [["a", "b", "c"], ["a"], ["d", "e", "f"]], "episodic_evidence": [["x"], ["y"], ["z"]]}})
    got = spark.createDataFrame([(nested,)], "j string").select(F.explode(captions.nested_triples(F.col("j"))).alias("t")).select("t.*").collect()
    assert [(r["id"], r["triple"], r["evidence"]) for r in got] == [("semantic_11_0", ["a", "b", "c"], ["x"]), ("semantic_11_2", ["d", "e", "f"], ["z"])]
    captions.write_csv(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), str(tmp_path / "csv"), ["a", "b", "absent"])
    assert [tuple(r) for r in captions.read_csv(spark, str(tmp_path / "csv"), "a int, b int, other string").collect()] == [(1, None, None)]


def test_text_and_time(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.first_person(F.lit("Jake: I saw jake's cup. Jake left, Jakes stayed"), "A1_JAKE")) == "I saw my cup. I left, Jakes stayed"
    assert one(T.speaker_name(F.lit("A1_JAKE"))) == "Jake" and one(T.speaker_name(F.lit("solo"))) == "Solo"
    assert one(T.render(F.array(*map(F.lit, (" a ", "", "a", "b"))), "A1_JAKE")) == "a b"
    assert one(T.plain(F.lit("a—b “c” ″…"))) == "a-b \"c\" ''..."
    assert [one(T.surface_form(F.lit(x))) for x in ("her", "what he held", "the my blue cup", "café")] == [None, None, "blue cup", "café"]
    assert one(T.manipulated(F.array(*map(F.lit, ("I", "picks up", "the cup"))))) == "cup" and one(T.manipulated(F.array(*map(F.lit, ("I", "says", "the cup"))))) is None
    assert one(K.time_range(F.lit("DAY1 11:09:43 - DAY 2 1:09:58"))).asDict() == {"start": 111094300, "end": 201095800} and one(K.time_range(F.lit("DAY1"))) is None
    none = F.lit(None).cast("array<string>")
    assert [tuple(x) for x in one(K.target_times(F.lit("DAY1"), F.lit("11153417DAY1_11181201"), none))] == [(111153417, 111181201)]
    assert [tuple(x) for x in one(K.target_times(F.lit("DAY3"), F.lit(""), F.array(F.lit("7000000"))))] == [(307000000, 307000000)]
    assert one(K.roll_over(F.lit(105960))) == 110000 and one(K.file_clock(F.lit("DAY1_A1_JAKE_11094208.mp4"))).asDict() == {"day": "DAY1", "clock": "11094208"}
