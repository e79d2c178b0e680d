"""Jobs, leases and runs as event-time state machines.

Each machine is one fold over a key's events in order of time.  Arrivals may be out of order within `late`:
an event waits in state until the watermark is past it; then all that are due are handed on, sorted.  What a
machine emits is therefore the same however the events were cut into micro-batches, and the same as the
batch operators give.

* `deliveries`: a job's first delivery, and each that comes more than the time to live after the last one
  that counted; the state is that one time, and a timeout drops it when the time to live has passed.
* `lease_expiries`: a lease that no later event of its job ends in time; a timeout at its end emits it.
* `stage_changes`: a run's state whenever an event changes it; the state is a status per stage, dropped when
  the run has been silent for `idle`.

Keys share `BUCKETS` pieces of state by their hash, as they share the partitions of a stream's state anyway: a
micro-batch then costs a call per bucket, not one per key and timer.  Like those partitions, their number holds
for a stream's life.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimloom import vocab as V

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Pieces of state that the keys of a stream share; what one holds must fit a Python worker.
BUCKETS = 4096

#: A time that is null comes before all others.
_NEVER = -(2**63) // 1000
#: Times in JSON keep their micros.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class InOrder:
    """Hands a key's events on in order of (time, order).  Events are (micros, order, fields as JSON); what a machine
    remembers is one JSON value."""

    # what a machine does

    def step(self, key: str | None, kept, at: int, row: dict) -> tuple[object, list[dict]]:
        """(what to remember after an event, rows to emit); times of rows are micros."""
        raise NotImplementedError

    def until(self, kept) -> int | None:
        """The time in micros up to which a memory can matter, if there is one."""
        raise NotImplementedError

    def end(self, key: str | None, kept) -> list[dict]:
        """Rows to emit when that time has passed."""
        return []

    def after(self, kept):
        """What is remembered once that time has passed."""
        return None

    # how it is driven

    def __call__(self, bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A bucket's new events, or its timeout: state is (key, what is kept, events that wait) of each key."""
        now = state.getCurrentWatermarkMs() * 1000
        held = {key: (kept, waiting) for key, kept, waiting in (json.loads(state.get[0]) if state.exists else [])}
        if not state.hasTimedOut:
            for part in parts:
                for key, *event in zip(part["key"], part["at"], part["order"], part["row"]):
                    held.setdefault(None if pd.isna(key) else key, (None, []))[1].append(event)
        out: list[dict] = []
        left, wake = [], None
        for key, (kept, waiting) in held.items():
            kept, waiting, limit = self._pass(key, kept, waiting, now, out)
            if kept is not None or waiting:
                left.append((key, kept, waiting))
                next_at = min([e[0] for e in waiting] + ([] if limit is None else [limit]), default=None)
                wake = next_at if wake is None else wake if next_at is None else min(wake, next_at)
        if left:
            state.update((json.dumps(left),))
            if wake is not None:
                # at the next full millisecond, when the watermark has passed the event
                state.setTimeoutTimestamp(max(wake // 1000, now // 1000) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"out": [json.dumps(r) for r in out]})

    def _pass(self, key, kept, waiting: list, now: int, out: list[dict]) -> tuple[object, list, int | None]:
        """Hand on a key's events that the watermark has passed: (what is kept, what waits on, until when)."""
        # before the first watermark nothing is due, not even events without a time
        due = sorted((e for e in waiting if e[0] < now), key=lambda e: (e[0], len(e[1]), e[1])) if now > 0 else []
        for at, _, row in due:
            limit = None if kept is None else self.until(kept)
            if limit is not None and limit < at:
                out += self.end(key, kept)
                kept = self.after(kept)
            kept, some = self.step(key, kept, at, json.loads(row))
            out += some
        limit = None if kept is None else self.until(kept)
        if limit is not None and limit < now:
            out += self.end(key, kept)
            kept, limit = self.after(kept), None
        return kept, [e for e in waiting if e[0] >= now] if due else waiting, limit


class _Deliveries(InOrder):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, key, kept, at, row):
        if kept is not None and at - kept <= self.ttl:
            return kept, []
        return at, [{"job_id": key, "ts": at, **row}]

    def until(self, kept):
        return kept + self.ttl


class _Leases(InOrder):
    """Remembers (reserved at, attempt, ends at) of an open lease."""

    def step(self, key, kept, at, row):
        if row["event"] == "reserve":
            return [at, row["attempt"], None if row["lease_seconds"] is None else at + row["lease_seconds"] * 1_000_000], []
        return (None if row["event"] in ("complete", "fail") else kept), []

    def until(self, kept):
        return kept[2]

    def end(self, key, kept):
        at, attempt, ends = kept
        return [{"job_id": key, "reserved_at": at, "lease_expires_at": ends, "next_attempt": None if attempt is None else attempt + 1}]


class _Stages(InOrder):
    """Remembers (status per stage, the state last told, the last event's time, how often it was told)."""

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, key, kept, at, row):
        stages, told, _, n = kept or ({}, None, 0, 0)
        stages[row["stage"]] = row["status"]
        wanted = [s for s in V.STAGE_SEQUENCE if s != "ANALYZING_MEDIA" or row["has_media"]]
        held = {s: stages[s] for s in wanted if s in stages}
        failed = [s for s, x in held.items() if x == "FAILED"]
        soft = sorted(f"{s.lower()}_failed" for s in failed if s not in V.FATAL_STAGES)
        if any(s in V.FATAL_STAGES for s in failed):
            status = "FAILED"
        elif all(held.get(s) in ("FAILED", *V.DONE_STAGE_STATUSES) for s in wanted):
            status = "COMPLETED"
        else:
            status = "RUNNING" if held else "QUEUED"
        now = [status, ",".join(soft)]
        if now == told:
            return [stages, now, at, n], []
        row = {"verification_id": key, "change": n + 1, "ts": at, "status": status, "degradation_reasons": now[1], "degraded": bool(soft)}
        return [stages, now, at, n + 1], [row]

    def until(self, kept):
        return kept[2] + self.idle


def _run(
    events: DataFrame, key: str, fields: list[str], machine: InOrder, schema: str, times: list[str], order: str, late: str, buckets: int
) -> DataFrame:
    """What a machine emits, of `schema`, where `times` are micros.  Events and rows pass Python as JSON, whole in any type."""
    events.sparkSession.conf.set(*STORE)  # keeps state out of the heap; a stream keeps the store it began with
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = stream.select(
        "ts",  # late events are told by it
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(key).cast("string").alias("key"),
        F.coalesce(F.unix_micros("ts"), F.lit(_NEVER)).alias("at"),
        F.coalesce(F.col(order).cast("string"), F.lit("")).alias("order"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false", **_JSON}).alias("row"),
    )
    told = rows.groupBy("bucket").applyInPandasWithState(machine, "out string", "keys string", "append", GroupStateTimeout.EventTimeTimeout)
    out = told.select(F.from_json("out", schema, _JSON).alias("o")).select("o.*")
    return out.withColumns({t: F.timestamp_micros(t) for t in times})


def deliveries(
    jobs: DataFrame, ttl_seconds: int = V.JOB_TTL_SECONDS, order: str = "event_id", late: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """A stream of those rows of jobs(job_id, ts, ...) that hold the job's lock."""
    fields = [f for f in jobs.schema.fields if f.name not in ("job_id", "ts")]
    schema = ", ".join(["job_id string", "ts long", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])
    return _run(jobs, "job_id", [f.name for f in fields], _Deliveries(ttl_seconds * 1_000_000), schema, ["ts"], order, late, buckets)


def lease_expiries(log: DataFrame, order: str = "event_id", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """A stream of the leases that ran out, of log(job_id, ts, event, attempt, lease_seconds, <order>)."""
    schema = "job_id string, reserved_at long, lease_expires_at long, next_attempt int"
    fields = ["event", "attempt", "lease_seconds"]
    return _run(log, "job_id", fields, _Leases(), schema, ["reserved_at", "lease_expires_at"], order, late, buckets)


def stage_changes(
    log: DataFrame, order: str = "event_id", late: str = "1 hour", idle_seconds: int = 7 * 86_400, buckets: int = BUCKETS
) -> DataFrame:
    """A stream of state changes of runs, of log(verification_id, ts, stage, status, has_media, <order>)."""
    schema = "verification_id string, change int, ts long, status string, degradation_reasons string, degraded boolean"
    fields = ["stage", "status", "has_media"]
    return _run(log, "verification_id", fields, _Stages(idle_seconds * 1_000_000), schema, ["ts"], order, late, buckets)
