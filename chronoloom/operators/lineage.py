"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoint(), set where it is not."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="chronoloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written by checkpoint() under spark.checkpoint.dir; where that is unset, in local mode only, in a folder of our own."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as Parquet in the folder of checkpoint(), in files by ranges of a column, so that reading a range opens no other data.

    Unlike a checkpoint it keeps no constraints of its plan; those of text forms take the optimizer long in every later query.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
