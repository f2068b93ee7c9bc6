"""Groups as a stream of sorted rows, and what a Python task is handed at once."""

from pyspark.sql import functions as F

from tessera.llm.sentencepiece_scan import by_groups
from tessera.llm.storage import BYTES_PER_BATCH, bound_batches, in_bytes


def test_groups_that_go_on_over_batches_are_whole(spark):
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "3")
    try:
        rows = spark.range(60).select((F.col("id") % 7 * F.col("id") % 5).alias("uid"), F.col("id").alias("k")).union(spark.range(100, 101).selectExpr("9L", "id"))
        got = by_groups(rows, ["uid"], F.desc("k"), lambda g: {"uid": g["uid"][:1], "ks": [g["k"].tolist()]}, "uid long, ks array<long>").collect()
    finally:
        spark.conf.set(key, old)
    want: dict[int, list[int]] = {9: [100]}
    for i in reversed(range(60)):
        want.setdefault(i % 7 * i % 5, []).append(i)
    assert len(got) == len(want) and {r.uid: r.ks for r in got} == want


def test_batches_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    bound_batches(spark.range(1))
    assert in_bytes(spark.conf.get(key)) == BYTES_PER_BATCH
    spark.conf.set(key, "2m")
    bound_batches(spark.range(1))
    assert in_bytes(spark.conf.get(key)) == 2 << 20
    spark.conf.unset(key)
