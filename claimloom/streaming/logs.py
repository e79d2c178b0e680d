"""Usage windows, delivery dedup, retry routing, leases: batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.session import checkpoint_root


def operation_limit(operation: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, limit in V.OPERATION_LIMITS.items():
        out = F.when(operation == name, limit).otherwise(out)
    return out


def usage_windows(events: DataFrame, window: str = f"{V.USAGE_WINDOW_SECONDS} seconds", late: str = "1 hour") -> DataFrame:
    """Requests per (operation, fingerprint, fixed window) of events(ts, operation, fingerprint).

    The same code runs on a stream, where `late` bounds how long a window stays open.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    limit = operation_limit(F.col("operation"))
    return (
        source.groupBy(F.window("ts", window).alias("w"), "operation", "fingerprint")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "operation", "fingerprint", "requests",
            limit.alias("usage_limit"),
            (F.col("requests") <= limit).alias("allowed"),
            F.greatest(F.lit(0), limit - F.col("requests")).alias("remaining"),
        )
    )


def _past_ttl(times: list, last, ttl: timedelta) -> tuple[list[bool], object]:
    """Which of the sorted times begin a delivery, after `last`; the last of those that do."""
    keep = []
    for at in times:
        keep.append(last is None or at - last > ttl)
        last = at if keep[-1] else last
    return keep, last


def first_deliveries(jobs: DataFrame, ttl_seconds: int = V.JOB_TTL_SECONDS, order: str = "event_id") -> DataFrame:
    """Deliveries of jobs(job_id, ts, ...) that hold the job's lock: the first, and each that comes
    more than the time to live after the last one that held it.

    In batch, rows pass sorted by (job_id, ts, order) and only the last held time is remembered.  On
    a stream that time is the job's state, dropped once the watermark is past it.
    """
    ttl, columns = timedelta(seconds=ttl_seconds), jobs.columns
    if jobs.isStreaming:

        def held(key, parts, state):
            if state.hasTimedOut:
                state.remove()
                return
            rows = pd.concat(list(parts)).sort_values(["ts", order])
            last = state.get[0] if state.exists else None
            keep, last = _past_ttl([t.to_pydatetime() for t in rows["ts"]], last, ttl)
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + ttl).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
            yield rows[keep][columns]

        return (
            jobs.withWatermark("ts", f"{ttl_seconds} seconds")
            .groupBy("job_id")
            .applyInPandasWithState(held, jobs.schema, "last timestamp_ntz", "append", "EventTimeTimeout")
        )

    def pass_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, last = None, None
        for batch in batches:
            keep = []
            for one, at in zip(batch.column("job_id").to_pylist(), batch.column("ts").to_pylist()):
                if one != job:
                    job, last = one, None
                now, last = _past_ttl([at], last, ttl)
                keep += now
            yield batch.filter(pa.array(keep, pa.bool_()))

    return jobs.repartition("job_id").sortWithinPartitions("job_id", "ts", order).mapInArrow(pass_sorted, jobs.schema)


def route_failures(failures: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Route failures(job_id, attempt, retryable): dead_letter, or retry with the next attempt."""
    dead = ~F.col("retryable") | (F.col("attempt") >= max_attempts)
    return failures.withColumn("route", F.when(dead, "dead_letter").otherwise("retry")).withColumn(
        "next_attempt", F.when(~dead, F.col("attempt") + 1)
    )


def expired_leases(log: DataFrame, as_of: Column) -> DataFrame:
    """Jobs reserved but neither completed nor failed whose lease has run out.

    log(job_id, ts, event, attempt, lease_seconds) with events reserve, complete, fail.  One
    aggregate per job replaces the scan of every worker's list.
    """
    kind = F.col("event")
    per_job = log.groupBy("job_id").agg(
        F.max_by(
            F.struct("attempt", F.timestamp_seconds(F.unix_micros("ts") / 1e6 + F.col("lease_seconds")).alias("expires")),
            F.when(kind == "reserve", F.struct("ts", "attempt")),
        ).alias("r"),
        F.max(F.when(kind == "reserve", F.col("ts"))).alias("reserved_at"),
        F.max(F.when(kind.isin("complete", "fail"), F.col("ts"))).alias("ended_at"),
    )
    open_lease = F.col("reserved_at").isNotNull() & (
        F.col("ended_at").isNull() | (F.col("ended_at") < F.col("reserved_at"))
    )
    return per_job.where(open_lease & (F.col("r.expires") < as_of)).select(
        "job_id", "reserved_at", F.col("r.expires").alias("lease_expires_at"), (F.col("r.attempt") + 1).alias("next_attempt")
    )


def queue_depths(routed: DataFrame) -> DataFrame:
    """Pending and dead-letter depth."""
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("depth"))


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all input there is and return what it wrote, as a table.

    Offsets, state and output live in the shared checkpoint folder, so a lost executor resumes.
    """
    spark = stream.sparkSession
    home = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        target = f"{home}/out" if mode == "complete" else f"{home}/out/epoch={epoch}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{home}/state")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def route_stream(failures: DataFrame, retry_path: str, dead_path: str, checkpoint: str):
    """Start the stream that appends retries and dead letters to their own folders."""

    def write(batch: DataFrame, epoch: int) -> None:
        routed = route_failures(batch)
        for route, path in (("retry", retry_path), ("dead_letter", dead_path)):
            rows = routed.where(F.col("route") == route)
            rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        failures.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


__all__ = [
    "expired_leases", "first_deliveries", "queue_depths", "route_failures", "route_stream",
    "run_available", "usage_windows",
]
