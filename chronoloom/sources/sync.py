"""Sync files: JSON arrays of blocks {video_file, data: [{start, end, text, type}]}, one file a person, day and clock."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.timekeys import DAY
from chronoloom.operators.filters import without_days

SCHEMA = "array<struct<video_file: string, data: array<struct<start: string, end: string, text: string, type: string>>>>"


def _seconds(clock, day):
    """Seconds since day 1 of HHMMSS, padded to six digits; null if it is no clock."""
    c = F.lpad(clock, 6, "0")
    h, m, s = (F.substring(c, a, 2).try_cast("int") for a in (1, 3, 5))
    return F.when(clock.rlike("^[0-9]{1,6}$") & (m <= 59) & (s <= 59), (day - 1) * DAY + h * 3600 + m * 60 + s)


def read_sync(spark: SparkSession, folder: str, person: str, days: Iterable[int] | None = None, excluded: Iterable[int | str] = ()) -> DataFrame:
    """day, start, end (seconds since day 1), text, type, video_file of a person's files, in order of (start, end).

    Blank texts and malformed times go; an end before its start belongs to the next day.  days keeps only
    those; files of other people and of names without a day do not count.
    """
    f = spark.read.text(f"{folder}/{person}_*.json", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"_DAY(\d+)_", 1).try_cast("int").alias("day"), F.col("_metadata.file_name").alias("file"), F.from_json("value", SCHEMA).alias("blocks"))
    f = without_days(f.where("day is not null"), F.col("day"), excluded)
    if days is not None:
        f = f.where(F.col("day").isin(*days))
    b = f.select("day", "file", F.posexplode("blocks").alias("i", "b")).select("day", "file", "i", F.col("b.video_file").alias("video_file"), F.posexplode("b.data").alias("j", "d"))
    x = b.select("day", _seconds(F.col("d.start"), F.col("day")).alias("start"), _seconds(F.col("d.end"), F.col("day")).alias("end"), F.trim("d.text").alias("text"), F.coalesce("d.type", F.lit("caption")).alias("type"), F.coalesce("video_file", F.lit("")).alias("video_file"), "file", "i", "j")
    x = x.where("text <> '' and start is not null and end is not null").withColumn("end", F.when(F.col("end") < F.col("start"), F.col("end") + DAY).otherwise(F.col("end")))
    return x.orderBy("start", "end", "file", "i", "j").drop("file", "i", "j")
