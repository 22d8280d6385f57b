"""Caption files, arrays of JSON plain or inside zip archives, dense captions, nested stores and CSV reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, pos and the fields of every element of JSON files that hold one array."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{schema}>>").alias("xs"))
    return f.select("file", F.posexplode("xs").alias("pos", "x")).select("file", "pos", "x.*")


def read_zipped(spark: SparkSession, path: str, schema: str, member: str = ".json") -> DataFrame:
    """file, member, pos and the fields of every element of the JSON arrays inside zip archives; broken members give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for m in sorted(n for n in archive.namelist() if n.endswith(member)):
                    try:
                        xs = json.loads(archive.read(m))
                    except (ValueError, zipfile.BadZipFile):
                        continue
                    if isinstance(xs, list):
                        yield pd.DataFrame({"file": name, "member": m, "pos": range(len(xs)), "x": [json.dumps(x, ensure_ascii=False) for x in xs]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, pos int, x string")
    return raw.select("file", "member", "pos", F.from_json("x", schema).alias("x")).select("file", "member", "pos", "x.*")


def dense_captions(spark: SparkSession, path: str) -> DataFrame:
    """start, end, text, type of caption lines whose custom_id ends in -start-end."""
    r = spark.read.schema("custom_id string, translated_text string").json(path)
    p = F.split("custom_id", "-")
    return r.select(F.try_element_at(p, F.lit(-2)).try_cast("bigint").alias("start"), F.try_element_at(p, F.lit(-1)).try_cast("bigint").alias("end"), F.col("translated_text").alias("text"), F.lit("caption").alias("type")).where("start is not null and end is not null")


def nested_triples(json_text: Column) -> Column:
    """array of struct(id, node, triple, evidence) of a per-node store {"node": {"semantic_triples": [...], "episodic_evidence": [...]}}; ids are semantic_{node}_{position}."""
    store = F.from_json(json_text, "map<string, struct<semantic_triples: array<array<string>>, episodic_evidence: array<array<string>>>>")
    per = F.transform(
        F.map_entries(store),
        lambda e: F.filter(
            F.transform(e["value"]["semantic_triples"], lambda t, i: F.struct(F.concat(F.lit("semantic_"), e["key"], F.lit("_"), i.cast("string")).alias("id"), e["key"].alias("node"), t.alias("triple"), F.get(e["value"]["episodic_evidence"], i).alias("evidence"))),
            lambda x: F.size(x["triple"]) >= 3,
        ),
    )
    return F.flatten(F.filter(per, lambda x: x.isNotNull()))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named fields with a header, absent ones empty, others left out."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields)).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by name from the header, null where a cell does not parse or a column is absent."""
    raw = spark.read.option("header", True).csv(path)
    want = spark.createDataFrame([], schema).schema
    return raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))


def merge_first_lines(passages: DataFrame, text: str, order: str) -> DataFrame:
    """title, text: passages with the same first line as one, their bodies in order."""
    x = passages.select(order, F.substring_index(text, "\n", 1).alias("title"), F.col(text).alias("_t")).withColumn("_body", F.expr("substring(_t, length(title) + 2)"))
    g = x.groupBy("title").agg(F.sort_array(F.collect_list(F.struct(order, "_body"))).alias("_b"))
    return g.select("title", F.concat_ws("\n", "title", F.array_join(F.transform("_b", lambda b: b["_body"]), "\n")).alias("text"))
