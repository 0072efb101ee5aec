"""Intermediate tables in the folder that a cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new place for a table, deleted when the program ends. Only a local session may do without the setting: the
    executors of a cluster do not share the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    made = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, made)
    return made


def _gone(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    _gone(df.sparkSession, df._textloom_path)
