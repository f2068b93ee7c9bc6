"""Places of rows in the order of their group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: str, order: list[Column], bucket: Column, name: str, size: str | None = None) -> DataFrame:
    """``df`` with each row's place from 1 on in its group's ``order`` as ``name``, and the group's number of rows as ``size`` if asked for.

    ``bucket`` is a value that never falls along the order (a day, a range of ids). Rows are ordered within a bucket
    only; what comes before it is a running sum of the buckets' counts, which are one row a bucket. Null groups are one.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(by).orderBy("__bucket")
    sums = counts.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"), (F.sum("__n").over(ahead) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(by)).alias("__all"))
    own = rows.withColumn("__place", F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order)))
    joined = own.join(sums, F.col(by).eqNullSafe(F.col("__by")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__place")).alias(name), *([F.col("__all").alias(size)] if size else []))
