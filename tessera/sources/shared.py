"""Paths in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def run_dir(spark: SparkSession) -> str:
    """This application's folder in that of ``spark.checkpoint.dir``; where that is unset, in a temporary one on a local master, and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/tessera"
    return f"{top.rstrip('/')}/core-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written there, indexes too: for the end of a run, when its results are elsewhere. No DataFrame that reads of it can be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, and not lost with an executor."""
    df.write.parquet(path := shared_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
