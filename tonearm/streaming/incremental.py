"""Incremental scans and job state as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def new_paths(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of (filepath, modified): each path once, remembered for delay."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["filepath"])


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows by kind of event."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def job_sessions(events: DataFrame, ttl: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Job state that ends ttl after its last event: one row per user and session."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", ttl).alias("w"), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "n_events")


JOB = "job_id string, status string, done long, updated timestamp"


def job_states(events: DataFrame, ttl_seconds: int = 300, delay: str = "10 seconds") -> DataFrame:
    """A stream of (job_id, status, done, ts) as state: each batch gives the jobs it touched with their last status and all that is done.

    A job's state ends ttl_seconds after its last event, by event time, with a row of status 'expired'; later events begin anew.
    """

    def advance(key, batches, state):
        if state.hasTimedOut:
            done, last = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["expired"], "done": [done], "updated": [pd.Timestamp(last, unit="us")]})
            return
        done, last = state.get if state.exists else (0, 0)
        status, at = None, last
        for batch in batches:
            done += int(batch["done"].fillna(0).sum())
            newest = batch.loc[batch["ts"].idxmax()]
            if (us := int(newest["ts"].value // 1000)) >= at:
                status, at = newest["status"], us
        state.update((done, max(at, last)))
        state.setTimeoutTimestamp(max(at // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "done": [done], "updated": [pd.Timestamp(at, unit="us")]})

    watched = events.select("job_id", "status", "done", "ts").withWatermark("ts", delay)
    return watched.groupBy("job_id").applyInPandasWithState(advance, JOB, "done long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, once, with progress kept in checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
