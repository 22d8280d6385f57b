"""The row before, where ids have gaps."""

import duckdb

from chronoloom import catalog


def test_adjacent_distance_over_gaps(spark, tmp_path):
    rows = [(i, [float(i * k % 7) for k in range(1, 5)]) for i in (1, 2, 5, 9, 10, 30, 31)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(catalog.oracle_sql()["adjacent_distance"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["adjacent_distance"](spark, str(tmp_path)).collect()]
    assert len(want) == len(rows) - 1 and sorted(got) == sorted(want)
