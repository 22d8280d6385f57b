"""Artifacts of the engine as files: interval store, entity bank, chunks with their configuration, cuts and sweeps.

Tables are Parquet; a one-row metadata table stands beside them.  A new version is written to a folder of
its own first and takes the old one's place only when it is whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "interval_v1"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write df to path: as a folder beside it, renamed over the old one at the end."""
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(kind).save(new)
    hadoop, p, fs = _fs(df.sparkSession, path)
    if fs.exists(p):
        fs.delete(p, True)
    fs.rename(hadoop.Path(new), p)


def write_with_meta(df: DataFrame, path: str, meta: dict) -> None:
    """df under path/rows and meta, a JSON object in one row, under path/meta."""
    replace(df, f"{path}/rows")
    replace(df.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1), f"{path}/meta")


def read_with_meta(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.parquet(f"{path}/meta").first()["value"])


def write_interval_store(facts: DataFrame, path: str, **meta) -> None:
    """Facts in ranges of first_seen, sorted inside each, with the format's name."""
    write_with_meta(facts.repartitionByRange("first_seen").sortWithinPartitions("first_seen", "ks", "kp", "ko"), path, {"format": FORMAT, **meta})


def read_interval_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    rows, meta = read_with_meta(spark, path)
    if meta.get("format") != FORMAT:
        raise ValueError(f"{path} has format {meta.get('format')!r}, not {FORMAT}")
    return rows, meta


def write_entity_bank(bank: DataFrame, path: str) -> None:
    """One JSON object a line; mention times as they are."""
    replace(bank, path, "json")


def read_entity_bank(spark: SparkSession, path: str, schema: str = "entity_id string, surface_form string, location_label string, first_seen bigint, last_seen bigint, n_mentions bigint, mention_times array<bigint>") -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_chunks(chunks: DataFrame, path: str, config: dict, cuts: DataFrame | None = None, sweep: DataFrame | None = None) -> None:
    """Chunks with their configuration and statistics; cuts and the sweep of thresholds beside them."""
    s = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("seconds"), F.avg(F.length("text")).alias("mean_text_chars")).first()
    write_with_meta(chunks, f"{path}/chunks", {"config": config, "statistics": {"n_chunks": s["n"], "total_seconds": float(s["seconds"]), "mean_text_chars": s["mean_text_chars"]}})
    for name, df in (("boundaries", cuts), ("threshold_sweep", sweep)):
        if df is not None:
            replace(df, f"{path}/{name}")


# ---- keyed stores --------------------------------------------------------------------------------


class Checkpoint:
    """Results by key in JSON lines under a folder: appended part by part, later parts win, broken lines do not count."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def append(self, df: DataFrame, batch: int) -> None:
        """A part of a number above all before it; a part that was not finished leaves no file that counts."""
        df.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        """One row a key, the latest part's; lines cut short or without a key are left out."""
        from chronoloom.sources.records import last_wins, read_jsonl

        _, p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        rows = read_jsonl(self.spark, self.path, f"{self.schema}, _batch bigint").where(F.col(self.key).isNotNull())
        return last_wins(rows, self.key, F.coalesce("_batch", F.lit(-1).cast("bigint"))).drop("_batch")

    def pending(self, items: DataFrame) -> DataFrame:
        return items.join(self.read().select(self.key), self.key, "left_anti")

    def compact(self) -> None:
        """One line a key, the state that read() gives, in place of all parts."""
        replace(self.read().withColumn("_batch", F.lit(0).cast("bigint")), self.path, "json")


def insert_strings(store: DataFrame, texts: DataFrame, text: str, embed, prefix: str = "entity-") -> DataFrame:
    """store (id, content, vector) with the new texts: ids by hash, embedded (column in, column out) only where the id is missing."""
    from chronoloom.functions.textnorm import content_id

    new = texts.select(content_id(F.col(text), prefix).alias("id"), F.col(text).alias("content")).dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti")
    return store.unionByName(new.withColumn("vector", embed(F.col("content")).cast(store.schema["vector"].dataType)))


def delete_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")
