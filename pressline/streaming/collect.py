"""Bulk collection: recorded fetches in, candidates and rejects out, resumable at any point.

Each micro-batch is mapped by the source's connector and written into a folder of its own
number, so a batch that runs again after a failure replaces what it wrote. Where to go on
is the stream's offset (``sources.cursor``); what a batch held is kept beside its rows, so
the summary of a run reads a line a batch and no records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.sources import connectors, cursor


@dataclass(frozen=True)
class Collection:
    """One source's collection: where its recording lies, and a folder for all it makes."""

    connector_type: str
    source_id: int
    recording: str
    base: str
    overlap_minutes: int = 0
    batches_per_trigger: int = 16

    def run(self, spark: SparkSession, most_triggers: int | None = None) -> DataFrame:
        """Takes in what is there (or as much as so many triggers take) and returns the
        summary of all runs so far: batch, discovered, accepted, skipped, rejected, newest_us."""
        cursor.register(spark)
        stream = (
            spark.readStream.format("replay").option("path", self.recording).option("overlapMinutes", self.overlap_minutes).option("batchesPerTrigger", self.batches_per_trigger)
            .option("progress", f"{self.base}/progress").load()
        )
        done: list[int] = []

        def write(batch: DataFrame, n: int) -> None:
            found = connectors.collect(batch.select("value"), self.connector_type, self.connector_type).candidates
            rows = found.withColumn("source_id", F.lit(self.source_id))
            rows.write.mode("overwrite").parquet(f"{self.base}/batches/batch={n}")
            held = spark.read.parquet(f"{self.base}/batches/batch={n}")
            good = F.col("error").isNull() & ~F.col("skipped")
            one = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
            counts = held.agg(F.count("*").alias("discovered"), one(good).alias("accepted"), one(F.col("skipped")).alias("skipped"), one(F.col("error").isNotNull()).alias("rejected"), F.max("published_us").alias("newest_us"))
            counts.coalesce(1).write.mode("overwrite").json(f"{self.base}/counts/batch={n}")
            done.append(n)

        query = stream.writeStream.option("checkpointLocation", f"{self.base}/state").foreachBatch(write).start()
        try:
            if most_triggers is None:
                query.processAllAvailable()
            else:
                while len(done) < most_triggers and query.isActive:
                    query.awaitTermination(0.2)
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()
        return self.summary(spark)

    def summary(self, spark: SparkSession) -> DataFrame:
        schema = "batch int, discovered long, accepted long, skipped long, rejected long, newest_us long"
        return spark.read.schema(schema).json(f"{self.base}/counts")

    def candidates(self, spark: SparkSession) -> DataFrame:
        """The accepted candidates, each id once: of those that an overlap brought again the latest."""
        rows = spark.read.parquet(f"{self.base}/batches").where("error is null and not skipped")
        whole = F.struct(*(c for c in rows.columns if c not in ("source_id", "external_id")))
        latest = rows.groupBy("source_id", "external_id").agg(F.max_by(whole, F.struct("batch", F.xxhash64(F.to_json(whole)))).alias("r"))
        return latest.select("source_id", "external_id", "r.*")

    def rejects(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/batches").where("error is not null").select("batch", "external_id", "error")
