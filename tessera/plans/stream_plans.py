"""Queries of streaming and stateful operators, over the events table as far as it has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..sources import tables as T
from ..sources.retention import clean_files
from ..sources.shared import shared_path, written
from ..sources.store import Files
from ..streaming import jobs
from .registry import query


def streamed(spark: SparkSession, sf_dir: str, again: bool = False) -> tuple[DataFrame, str]:
    """The events as a stream of files, and the folder of the job; with ``again`` a third of them twice."""
    folder = shared_path(spark, "stream")
    e = T.raw(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value")
    e.write.parquet(f"{folder}/in")
    if again:
        e.filter("event_id % 6 = 0").unionByName(e.filter("event_id % 6 IN (0, 1)")).write.mode("append").parquet(f"{folder}/in")
    return jobs.event_stream(spark, f"{folder}/in"), folder


@query("SELECT event_id FROM events")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though a third of them come again, some in the same file and some in a later one."""
    events, folder = streamed(spark, sf_dir, again=True)
    return jobs.run_once(jobs.once(events.select("event_id", "ts")), "once", folder).select("event_id")


@query()
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = streamed(spark, sf_dir)
    return jobs.run_once(jobs.breaker(events.select("user_id", "event_id", "ts", "event_type")), "breaker", folder)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed."""
    events, folder = streamed(spark, sf_dir)
    return jobs.run_once(jobs.windowed_counts(events.select("ts", "event_type")), "counts", folder).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a user come in the hour up to each."""
    e = T.raw(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return e.select("event_id", M.within(F.col("s"), 3600, "user_id").alias("n"))


PRIORITY = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"SELECT event_id, max({PRIORITY}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events")
def monotone_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest phase of a user so far; phases never go back."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.raw(spark, sf_dir, "events").select("event_id", F.max(F.expr(PRIORITY)).over(w).alias("phase"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, epoch(max(date_trunc('second', ts))) AS t0 FROM events GROUP BY 1), m AS (SELECT max(t0) AS now FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, n FROM d, m WHERE t0 >= now - 10 * 86400 OR extract(day FROM day) % 4 = 3""")
def ttl_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts, one of the events of each day, that are left when those of over ten days went; every fourth is a text file, which the limit on JSON files doesn't concern."""
    folder = shared_path(spark, "artifacts")
    e = T.raw(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    days = written(e.groupBy("day").agg(F.count("*").alias("n"), F.max("at").alias("at")), "days")
    files = Files(spark, folder)
    now = 0
    for row in days.toLocalIterator():  # a small file a day
        kind = "txt" if int(row["day"][-2:]) % 4 == 3 else "json"
        files.create(path := f"{folder}/{row['day']}.{kind}", f'{{"day": "{row["day"]}", "n": {row["n"]}}}')
        files.fs.setTimes(files.at(path), row["at"] * 1000, -1)
        now = max(now, row["at"])
    clean_files(spark, "events", folder, ttl_days=10, now=now)
    return spark.read.schema("day string, n long").json(folder)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id > (SELECT max(conv_id) - 10 FROM conversations)")
def rescan_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of the last ten documents, read again and each taken once."""
    c = T.raw(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = c.agg((F.max("conv_id") - 10).alias("mark"))
    again = c.join(F.broadcast(last), F.col("conv_id") > F.col("mark")).select("conv_id", "turn")
    return again.unionByName(again).dropDuplicates(["conv_id", "turn"])
