"""The folder that driver and executors share, and tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one is set on a local master, as in tests; on a cluster that is an error, since executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder of this application that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has cut lineages with: for the end of a run, when its results are written. No DataFrame made by an operator can be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ROWS_PER_BATCH = 1000
#: A thousand of the longest texts would be tens of MB, in the JVM and in Python, for each task.
BYTES_PER_BATCH = 8 << 20


def in_bytes(size: str) -> int:
    """A size as the session's settings give it: a number of bytes, or of larger units by their letter."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python tasks batches of ROWS_PER_BATCH rows and about BYTES_PER_BATCH bytes at most, since rows here are whole texts. Smaller numbers that the session has stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        df.sparkSession.conf.set(key, str(ROWS_PER_BATCH))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < in_bytes(df.sparkSession.conf.get(key)) <= BYTES_PER_BATCH:
        df.sparkSession.conf.set(key, str(BYTES_PER_BATCH))
    return df


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs neither recompute it nor lose it with an executor, and joins get its true size."""
    spark = bound_batches(df).sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)
