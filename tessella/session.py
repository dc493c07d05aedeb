"""The Spark session with the settings that results rest on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessella", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Used only where the session names no folder for checkpoints and all executors are threads of one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tessella"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; without it, a cluster's executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def _goes_with(spark: SparkSession, path: str, make: bool = False) -> None:
    """Have a folder removed when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(where)
    fs.deleteOnExit(where)  # of what is there already


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/tessella-{label}-{uuid.uuid4().hex}"
    _goes_with(spark, path, make=True)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage is cut in storage that outlives executors. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _goes_with(spark, path)
    return spark.read.schema(df.schema).parquet(path)
