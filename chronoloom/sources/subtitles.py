"""SRT subtitles: a scan of whole files and a sink of numbered cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.timekeys import srt_clock


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """file, start, end (seconds) and text of every cue under path."""
    cues = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"\n\s*\n")).alias("cue"))
    at = r"(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)"
    g = [F.regexp_extract("cue", at, i).try_cast("double") for i in range(1, 9)]
    sec = lambda h, m, s, ms: h * 3600 + m * 60 + s + ms / 1000
    lines = F.filter(F.split("cue", "\n"), lambda x: ~x.rlike(r"^\s*\d+\s*$") & ~x.contains(" --> ") & (F.trim(x) != ""))
    return cues.where(F.col("cue").rlike(at)).select("file", sec(*g[:4]).alias("start"), sec(*g[4:]).alias("end"), F.array_join(F.transform(lines, F.trim), " ").alias("text"))


def srt_text(cues: DataFrame, by: str) -> DataFrame:
    """by and the SRT text of its cues (start, end, text), in order, blank ones left out."""
    c = cues.where(F.trim("text") != "").groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.trim("text").alias("text")))).alias("c"))
    body = F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_clock(x["start"]), F.lit(" --> "), srt_clock(x["end"]), F.lit("\n"), x["text"], F.lit("\n")))
    return c.select(by, F.array_join(body, "\n").alias("srt"))
