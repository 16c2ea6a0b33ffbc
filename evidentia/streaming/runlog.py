"""STRM-9, AGG-19: a log of what streams did, batch by batch, written by a listener."""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.timefn import age_hours
from ..operators.feeds import run_outcome

RUNS = "query string, run string, batch long, at timestamp, rows long, ok long, failed long"


class RunLog(StreamingQueryListener):
    """Writes the observed counts of every batch to a table.

    metric: the name under which the stream observes rows, ok and failed.  Batches wait in memory until there are `held`
    of them, or the query ends, so that the table has few files; progress that Spark itself keeps
    ends after a hundred batches, this doesn't."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "run", held: int = 50) -> None:
        super().__init__()
        self.spark, self.path, self.metric, self.held = spark, path, metric, held
        self.waiting: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> RunLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)
        self._write()

    def _end_of(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def _write(self) -> None:
        with self.lock:
            rows, self.waiting = self.waiting, []
        if rows:
            self.spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.metric)
        if seen is None:
            return
        at = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        with self.lock:
            self.waiting.append((str(p.id), str(p.runId), p.batchId, at, seen["rows"], seen["ok"], seen["failed"]))
            full = len(self.waiting) >= self.held
        if full:
            self._write()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write()
        self._end_of(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until a query has ended and all its batches are in the table."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of {query.runId} after {seconds} seconds")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(query, run, batch, at, rows, ok, failed); a batch that was run again counts as it was the last time."""
    rows = spark.read.schema(RUNS).parquet(path)
    last = F.max_by(F.struct("run", "at", "rows", "ok", "failed"), F.struct("at", "run"))
    return rows.groupBy("query", "batch").agg(last.alias("l")).select("query", "l.run", "batch", "l.at", "l.rows", "l.ok", "l.failed")


def freshness(runs: DataFrame, as_of: Column, stale_hours: int = 48) -> DataFrame:
    """AGG-19: (query, outcome, last_run, last_success, attempted, ok, failed, freshness, needs_attention) from runs (query, run, at, ok, failed).

    The last run says how it went; data are as new as the last run that brought anything.  freshness: never
    (no run did), failed (the last run brought nothing), stale or current."""
    each = runs.groupBy("query", "run").agg(F.max("at").alias("at"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    folded = each.groupBy("query").agg(
        F.max_by(F.struct("ok", "failed"), F.struct("at", "run")).alias("l"),
        F.max("at").alias("last_run"),
        F.max(F.when(F.col("ok") > 0, F.col("at"))).alias("last_success"),
    )
    outcome = run_outcome(F.col("l.ok"), F.col("l.failed"))
    state = F.when(F.col("last_success").isNull(), F.lit("never")).when(outcome == "TOTAL_FAILURE", "failed").when(age_hours(F.col("last_success"), as_of) > stale_hours, "stale").otherwise("current")
    return folded.select(
        "query", outcome.alias("outcome"), "last_run", "last_success", (F.col("l.ok") + F.col("l.failed")).alias("attempted"), "l.ok", "l.failed",
        state.alias("freshness"), outcome.isin("TOTAL_FAILURE", "PARTIAL").alias("needs_attention"),
    )
