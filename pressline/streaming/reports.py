"""Report days that close, reopen for a grace and close for good, on event time.

A day closes when the watermark passes its schedule. An update within the grace after
it has the report written once more, when the grace is over; what comes later changes
nothing, and the day's state is removed. State is two counts a day; timers do the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pressline.operators.daily import scheduled_instant
from pressline.operators.search import civil_date

GRACE_US = 15 * 60_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "report_date string, action string, at_us long, updates long"


def _row(report_date: str, action: str, at_us: int, updates: int) -> pd.DataFrame:
    return pd.DataFrame({"report_date": pd.Series([report_date], dtype=object), "action": pd.Series([action], dtype=object), "at_us": [at_us], "updates": [updates]})


class Closing(StatefulProcessor):
    """Rows of one day: updated_us, scheduled_us."""

    def __init__(self, grace_us: int):
        self.grace_us = grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "scheduled_us long, before long, grace long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, before, grace, closed = self.counts.get() if self.counts.exists() else (None, 0, 0, False)
        new, now = due is None, timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            due = int(part["scheduled_us"].iloc[0])
            at = part["updated_us"]
            # timers fire after the rows of a batch, so what is over is told by the watermark
            before += int((at <= due).sum()) if now < due else 0
            grace += int(((at > due) & (at <= due + self.grace_us)).sum()) if now < due + self.grace_us else 0
        if new and now >= due + self.grace_us:
            return iter(())  # the day is over for good, and its state is gone
        if new:
            self.handle.registerTimer(due // 1000)
            self.handle.registerTimer((due + self.grace_us) // 1000)
        self.counts.update((due, before, grace, closed))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, before, grace, closed = self.counts.get()
        if not closed:
            closed = True
            self.counts.update((due, before, grace, closed))
            yield _row(key[0], "closed", due, before)
        if expiredTimerInfo.getExpiryTimeInMs() >= (due + self.grace_us) // 1000:
            self.counts.clear()
            if grace:
                yield _row(key[0], "regenerated", due + self.grace_us, before + grace)

    def close(self) -> None:
        pass


def closing_stream(updates: DataFrame, late: str = "1 hour", grace_us: int = GRACE_US) -> DataFrame:
    """report_date, action (closed or regenerated), at_us, updates of a stream of updates
    (report_date, ts). The session's state store must be RocksDB, see ``with_rocks``."""
    rows = updates.withWatermark("ts", late).select("report_date", "ts", F.unix_micros("ts").alias("updated_us"), scheduled_instant(F.col("report_date")).alias("scheduled_us"))
    return rows.groupBy("report_date").transformWithStateInPandas(Closing(grace_us), OUT, "Append", "EventTime")


def closing_table(updates: DataFrame, late_us: int = 3_600_000_000, grace_us: int = GRACE_US) -> DataFrame:
    """The same of a table, as of its newest update less the allowed lateness."""
    rows = updates.select("report_date", F.unix_micros("ts").alias("updated_us"), scheduled_instant(F.col("report_date")).alias("scheduled_us"))
    now = rows.agg(F.floor((F.max("updated_us") - late_us) / 1000)).scalar()
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    day = rows.groupBy("report_date", "scheduled_us").agg(count(F.col("updated_us") <= F.col("scheduled_us")).alias("before"), count((F.col("updated_us") > F.col("scheduled_us")) & (F.col("updated_us") <= F.col("scheduled_us") + grace_us)).alias("grace"))
    steps = F.array(F.struct(F.lit("closed").alias("action"), F.col("scheduled_us").alias("at_us"), F.col("before").alias("updates")), F.when(F.col("grace") > 0, F.struct(F.lit("regenerated").alias("action"), (F.col("scheduled_us") + grace_us).alias("at_us"), (F.col("before") + F.col("grace")).alias("updates"))))
    found = day.select("report_date", F.explode(F.array_compact(steps)).alias("s")).where(F.floor(F.col("s.at_us") / 1000) <= now)
    return found.select("report_date", "s.action", "s.at_us", "s.updates")


def report_updates(events: DataFrame) -> DataFrame:
    """Events as updates of reports: a seventh of the users write about the day before."""
    day = F.date_sub(civil_date(F.unix_micros("ts")), F.when(F.col("user_id") % 7 == 0, 1).otherwise(0))
    return events.select(day.cast("string").alias("report_date"), "ts")


class with_rocks:
    """The session's state store is RocksDB inside the block; timers and named states need it."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.KEY)
        self.conf.set(self.KEY, ROCKS)

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.before)
