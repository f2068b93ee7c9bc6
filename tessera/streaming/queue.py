"""A work queue as a stateful stream: groups that wait for their analysis, with retries by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a group's event says: when it was put into the queue, with how many comments, and what the work needs.
EVENT = "group_id long, at timestamp, n_comments long, payload string"
STEP = "group_id long, at timestamp, state string, attempts int"
STEP_ROW = Row("group_id", "at", "state", "attempts")
ATTEMPTS, BACKOFF = 3, 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def never_fails(group_id: int, payload: str, attempt: int) -> None:
    """The default work: nothing to do."""


class Queue(StatefulProcessor):
    """pending, then checked; no-comments for a group without any; error after ``attempts`` failures, ``backoff`` seconds apart, then twice, four times that.

    A group's state is four numbers and its payload. Retries that are due before an event of the group come
    before it, those due by the watermark come with their timer, so what becomes of a group doesn't depend on how its events are
    cut into batches, as long as none comes after the watermark. A further event of a group starts it anew.
    """

    def __init__(self, work: Callable[[int, str, int], None] = never_fails, attempts: int = ATTEMPTS, backoff: int = BACKOFF):
        self.work, self.attempts, self.backoff = work, attempts, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "due double, attempts int, payload string")

    def tried(self, group: int, at: float, attempts: int, payload: str) -> tuple[tuple, tuple | None]:
        """The step of one attempt, and what then waits."""
        try:
            self.work(group, payload, attempts)
            return (group, at, "checked", attempts), None
        except Exception:  # whatever the work raises is a failure of the group
            if attempts >= self.attempts:
                return (group, at, "error", attempts), None
            return (group, at, "pending", attempts), (at + self.backoff * 2 ** (attempts - 1), attempts + 1, payload)

    def until(self, group: int, waits: tuple | None, end: float, out: list[tuple]) -> tuple | None:
        """Attempts that are due by ``end``, one after another."""
        while waits is not None and waits[0] <= end:
            step, waits = self.tried(group, *waits)
            out.append(step)
        return waits

    def steps(self, group: int, waits: tuple | None, events: list[tuple[float, int, str]]) -> tuple[list[tuple], tuple | None]:
        """What the events (at, n_comments, payload; in order) of a group make of it."""
        out: list[tuple] = []
        for at, n, payload in events:
            waits = self.until(group, waits, at, out)
            if n:
                step, waits = self.tried(group, at, 1, payload)
                out.append(step)
            else:
                out.append((group, at, "no-comments", 0))
                waits = None
        return out, waits

    def _kept(self, before: tuple | None, waits: tuple | None) -> None:
        """Every call here is a message to the JVM, so a group that nothing changes for makes none."""
        if waits == before:
            return
        if before is not None:
            self.handle.deleteTimer(int(before[0] * 1000))
        if waits is None:
            self.waiting.clear()
        else:
            self.waiting.update(waits)
            self.handle.registerTimer(int(waits[0] * 1000))

    def _waiting(self) -> tuple | None:
        found = self.waiting.get()
        return None if found is None else tuple(found)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = sorted(((r["seconds"], int(r["n_comments"]), r["payload"]) for r in rows), key=lambda e: (*e[:2], e[2] is None, e[2] or ""))
        before = self._waiting()
        out, waits = self.steps(int(key[0]), before, found)
        self._kept(before, waits)
        yield from (STEP_ROW(*step) for step in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out: list[tuple] = []
        before = self._waiting()
        waits = self.until(int(key[0]), before, timerValues.getCurrentWatermarkInMs() / 1000, out)
        self._kept(before, waits)
        yield from (STEP_ROW(*step) for step in out)

    def close(self) -> None:
        pass


@contextmanager
def timers(spark: SparkSession):
    """State with timers needs the RocksDB store; the session's own is put back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def worked(events: DataFrame, work: Callable[[int, str, int], None] = never_fails, attempts: int = ATTEMPTS, backoff: int = BACKOFF, late: str = "0 seconds") -> DataFrame:
    """STEP for each step of each group of a stream of EVENT; run it within ``timers``."""
    timed = events.withWatermark("at", late).withColumn("seconds", F.col("at").cast("double"))
    steps = timed.groupBy("group_id").transformWithState(Queue(work, attempts, backoff), STEP.replace("at timestamp", "at double"), "append", "eventTime")
    return steps.withColumn("at", F.timestamp_seconds("at"))
