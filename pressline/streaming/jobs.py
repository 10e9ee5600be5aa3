"""Structured Streaming twins of the incremental queries. Each has a transformation
that works on a stream or a table, so that a run over everything available can be
compared with its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pressline.functions.lineage import shared_dir

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The events folder as a stream, with ``ts`` as an instant (watermarks need one)."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return raw.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """First row of each key; keys are remembered for the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def civil_days(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts per Shanghai day and type: tumbling windows of a day that start at 16:00 UTC."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", "1 day", "1 day", "16 hours")
    counted = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("value", 4).alias("value"))


def rolling_day(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts of the last 24 hours, every hour, per type: sliding windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over everything available and returns what it wrote. In append
    mode a parquet sink commits each batch once; in complete and update mode every
    batch writes its own folder and the last (complete) or all (update) are read."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append" and each is None:
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    seen: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        (each or (lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/{i}")))(batch, n)
        seen.append(n)

    writer.foreachBatch(write).start().awaitTermination()
    if each is not None or not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([f"{base}/out/{max(seen)}"] if mode == "complete" else [f"{base}/out/{n}" for n in seen]))


def ingested(arrivals: DataFrame) -> DataFrame:
    """Idempotent ingest of a stream (key, arrival, content_hash): a row makes a revision
    if its content differs from the latest one of its key. The latest hash and revision of
    each key are state, so a batch reads nothing of what was taken in before, and a batch
    that is run again starts from the state before it. Within a batch a key's rows go by
    arrival."""

    def run(key, frames, state):
        last, revision = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        made = []
        for arrival, content in zip(rows["arrival"], rows["content_hash"]):
            if content != last:
                last, revision = content, revision + 1
                made.append((key[0], arrival, content, revision))
        state.update((last, revision))
        if made:
            yield pd.DataFrame(made, columns=["key", "arrival", "content_hash", "revision"])

    return arrivals.groupBy("key").applyInPandasWithState(
        run, "key long, arrival long, content_hash string, revision long", "content_hash string, revision long", "append", GroupStateTimeout.NoTimeout
    )
