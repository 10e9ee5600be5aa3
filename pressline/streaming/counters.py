"""What a run took in, counted while it runs: metrics that ride along with each batch,
collected by a listener. No second pass over the data, none over the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTS = ("discovered", "created", "revised")


def observed_arrivals(arrivals: DataFrame) -> DataFrame:
    """Arrivals, with their number observed under the name ``arrivals``."""
    return arrivals.observe("arrivals", F.count(F.lit(1)).alias("discovered"))


def observed_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions (column revision), with first and further ones observed under the name ``revisions``."""
    one = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return revisions.observe("revisions", one(F.col("revision") == 1).alias("created"), one(F.col("revision") > 1).alias("revised"))


class RunCounters(StreamingQueryListener):
    """Sums the observed metrics of the queries of a session by their run. A batch that is
    run again after a failure is a further progress event of another run; within a run
    each batch counts once."""

    def __init__(self):
        self.batches: dict[str, dict[int, dict[str, int]]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event):
        self.batches[str(event.runId)] = {}

    def onQueryProgress(self, event):
        p = event.progress
        metrics: dict[str, int] = {}
        for row in p.observedMetrics.values():
            metrics |= {k: v for k, v in row.asDict().items() if k in COUNTS}
        if metrics:
            self.batches.setdefault(str(p.runId), {})[p.batchId] = metrics

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)] = event.exception

    def run(self, run_id) -> dict[str, int]:
        """discovered, created, revised and skipped of a run."""
        sums = {k: sum(b.get(k, 0) for b in self.batches.get(str(run_id), {}).values()) for k in COUNTS}
        return {**sums, "skipped": sums["discovered"] - sums["created"] - sums["revised"]}


def counted_run(spark: SparkSession, start) -> dict[str, int]:
    """Runs a query that ``start()`` starts to its end and returns its counts and status."""
    import time

    counters = RunCounters()
    spark.streams.addListener(counters)
    try:
        query = start()
        failure = None
        try:
            query.awaitTermination()
        except Exception as e:  # the query's own failure is part of the record
            failure = str(e)[:4000]
        run_id = str(query.runId)
        for _ in range(600):  # events come after the query's end
            if run_id in counters.ended:
                break
            time.sleep(0.1)
        return {**counters.run(run_id), "status": "failed" if failure else "completed", "error": failure}
    finally:
        spark.streams.removeListener(counters)


def as_frame(spark: SparkSession, counts: dict) -> DataFrame:
    return spark.createDataFrame([Row(**counts)], "discovered long, created long, revised long, skipped long, status string, error string")
