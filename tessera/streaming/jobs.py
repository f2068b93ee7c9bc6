"""Structured Streaming jobs; each has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type and hour; what is later than ``late`` is dropped with the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once: repeats within the watermark are skipped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def breaker(events: DataFrame, failures: int = 5, seconds: int = 30) -> DataFrame:
    """user_id, event_id, state (closed, open, half-open) of a circuit breaker per user: it opens after so many errors in a row and tries again after so many seconds.

    A key's state is three numbers. Spark hands a key's events of a micro-batch over in pieces of any order, so they are
    put in order together: three values an event; ``maxFilesPerTrigger`` of the source bounds a micro-batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, opened, is_open = state.get if state.exists else (0, 0.0, False)
        events, out = pd.concat([b[["ts", "event_id", "event_type"]] for b in batches]).sort_values(["ts", "event_id"]), []
        for at, kind in zip(events["ts"], events["event_type"], strict=True):
            now = at.timestamp()
            said = "closed" if not is_open else "half-open" if now - opened >= seconds else "open"
            if said != "open":
                errors = errors + 1 if kind == "error" else 0
                if kind == "error" and (said == "half-open" or errors >= failures):
                    is_open, opened = True, now
                elif kind != "error":
                    is_open = False
            out.append(said)
        state.update((errors, opened, is_open))
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"], "state": out})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "errors int, opened double, is_open boolean", "append", "NoTimeout")


def run_once(df: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table of files under ``folder``, and read that."""
    spark = df.sparkSession
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
