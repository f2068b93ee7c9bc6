"""What keeps costs from growing faster than the input."""

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_a_word_is_hashed_once_for_all_places(spark):
    rows = spark.createDataFrame([("the fox",)], "text string").select(R.hashed_embedding(F.col("text")).alias("v"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1 and plan.count("filter(") == 1  # the one filter is that of empty tokens, not one a place


def test_confidence_gate_reads_the_texts_once(spark):
    assert not [p for p in catalog.queries()["confidence_gate"](spark, SMALL).inputFiles() if "documents" in p]


def test_representatives_read_the_texts_once(spark):
    assert not [p for p in catalog.queries()["representatives"](spark, SMALL).inputFiles() if "documents" in p]
