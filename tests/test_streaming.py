"""Streams against the batch operators, joins that must find, approximate neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import facts, joins, sequences, similarity
from chronoloom.streaming import facts as stream


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_elapsed_nodes_stream(spark, tmp_path):
    rows = [(u, float(t), i) for u in (1, 2) for i, t in enumerate(range(0, 100, 7 + u))]
    df = spark.createDataFrame(rows, "u int, t double, i int").withColumn("e", F.col("t"))
    for n, part in enumerate((df.where("t < 40"), df.where("t >= 40"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _run(stream.elapsed_nodes(src, "u", "t", "e", "i", 20.0), "nodes")
    want = sequences.elapsed_nodes(df, ["u"], "t", "e", "i", 20.0)
    assert sorted(tuple(r) for r in spark.sql("select u, t, node from nodes where not late").collect()) == sorted(tuple(r) for r in want.select("u", "t", "node").collect())


def test_fact_store_stream(spark, tmp_path):
    t = spark.createDataFrame([("I", "drink", "coffee", f"{i:02d}") for i in range(8)] + [("Bob", "reads", "books", "03")], "s string, p string, o string, node string")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = src.writeStream.foreachBatch(stream.fold_batches(str(tmp_path / "store"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream.fold_batches(str(tmp_path / "again"))(t, 0), stream.fold_batches(str(tmp_path / "again"))(t, 0)  # a replay changes nothing
    cols = ["ks", "ko", "support", "first_seen", "last_seen"]
    for path in ("store", "again"):
        assert sorted(tuple(r) for r in stream.stored_facts(spark, str(tmp_path / path)).select(cols).collect()) == sorted(tuple(r) for r in facts.fold_facts(t).select(cols).collect())
    held = t.where("node <= '03'")
    assert sorted(r["node"] for r in stream.advance(t, held, "05").collect()) == ["04", "05"] and stream.advance(t, held, "02").isEmpty() and stream.advance(t, t.limit(0), "01").count() == 2


def test_required_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.required(a.where("k = 1"), b, "k", "v").collect()[0]["v"] == "x"
    with pytest.raises(Exception, match="no match for 2"):
        joins.required(a, b, "k", "v").collect()


def test_approximate_neighbours(spark):
    r = np.random.RandomState(1)
    centre = r.normal(size=(40, 16))
    x = np.repeat(centre, 10, axis=0) + 0.15 * r.normal(size=(400, 16))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "id long, v array<double>")
    q = df.where("id % 20 = 0")
    near = {(e["src"], e["dst"]) for e in similarity.approximate(q, df, "id", "v", 5).collect()}
    exact = {(e["src"], e["dst"]) for e in similarity.matches(q, df, "id", "v", None, 5).collect()}
    assert len(exact) == 100 and len(near & exact) >= 90
