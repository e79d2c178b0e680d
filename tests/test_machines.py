"""State machines on streams against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import report as P
from claimloom.streaming import logs as L
from claimloom.streaming import machines

T0 = datetime(2024, 1, 1)
CLOCK = T0 + timedelta(days=30)


def landed(spark, tmp_path, rows, schema, files, seed):
    """A stream of rows in files of any order, the last file a clock."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    home = str(tmp_path / f"in{seed}")
    clock = [tuple("clock" if i == 0 else CLOCK if i == 1 else x for i, x in enumerate(rows[0]))]
    for part in [rows[i::files] for i in range(files)] + [clock]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(home)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(home)


def left_over(spark, stream, tmp_path, name):
    """(rows emitted, entries of state left at the end)."""
    out = str(tmp_path / name)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", out + "-ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(out), states


def jobs():
    pick = random.Random(2)
    return [(f"j{k}", T0 + timedelta(seconds=s), k * 100 + n) for k in range(4) for n, s in enumerate(sorted(pick.choices(range(0, 6000, 50), k=20)))]


@pytest.mark.parametrize("files, seed", [(1, 1), (4, 2)])
def test_deliveries_equal_batch(spark, tmp_path, files, seed):
    schema = "job_id string, ts timestamp, event_id long"
    stream = machines.deliveries(landed(spark, tmp_path, jobs(), schema, files, seed), 900, late="3 hours")
    got, states = left_over(spark, stream, tmp_path, "out")
    want = L.first_deliveries(spark.createDataFrame(jobs(), schema), 900)
    found = sorted(map(tuple, got.where("job_id <> 'clock'").select(want.columns).collect()))
    assert found == sorted(map(tuple, want.collect()))
    assert max(states) > states[-1] and states[-1] <= 4  # the clock's own event waits, nothing else


def leases():
    pick = random.Random(5)
    out = []
    for k in range(6):
        at, n = 0, 0
        for _ in range(8):
            at += pick.choice([30, 200, 899, 900, 901, 2000])
            out.append((f"j{k}", T0 + timedelta(seconds=at), pick.choice(["reserve", "reserve", "complete", "fail"]), n % 3 + 1, 900, k * 100 + n))
            n += 1
    return out


@pytest.mark.parametrize("files, seed", [(1, 3), (5, 4)])
def test_leases_run_out(spark, tmp_path, files, seed):
    schema = "job_id string, ts timestamp, event string, attempt int, lease_seconds int, event_id long"
    stream = machines.lease_expiries(landed(spark, tmp_path, leases(), schema, files, seed), late="6 hours")
    got, states = left_over(spark, stream, tmp_path, "out")
    want = set()
    for job in {r[0] for r in leases()}:
        own = sorted((r for r in leases() if r[0] == job), key=lambda r: (r[1], r[5]))
        for r, after in zip(own, [*own[1:], None]):
            ends = r[1] + timedelta(seconds=900)
            if r[2] == "reserve" and (after is None or after[1] > ends):
                want.add((job, r[1], ends, r[3] + 1))
    found = [tuple(r) for r in got.where("job_id <> 'clock'").collect()]
    assert set(found) == want and len(found) == len(want)
    # those that nothing followed are what the batch operator lists
    last = {job: max(r[1] for r in leases() if r[0] == job) for job in {r[0] for r in leases()}}
    batch = L.expired_leases(spark.createDataFrame(leases(), schema).drop("event_id"), F.lit(CLOCK))
    assert {tuple(r) for r in batch.collect()} == {w for w in want if w[1] == last[w[0]]}
    assert states[-1] <= 4


def test_stage_changes_end_in_the_batch_state(spark, tmp_path):
    pick = random.Random(8)
    from claimloom import vocab as V

    log = [
        (f"v{k}", T0 + timedelta(seconds=60 * n), pick.choice(V.STAGE_SEQUENCE) if k else V.STAGE_SEQUENCE[n % 12],
         pick.choice(["RUNNING", "COMPLETED", "FAILED", "SKIPPED"]) if k else "COMPLETED", k % 2 == 0, k * 100 + n)
        for k in range(6) for n in range(24)
    ]
    schema = "verification_id string, ts timestamp, stage string, status string, has_media boolean, event_id long"
    stream = machines.stage_changes(landed(spark, tmp_path, log, schema, 4, 6), late="3 hours")
    got, states = left_over(spark, stream, tmp_path, "out")
    last = got.where("verification_id <> 'clock'").groupBy("verification_id").agg(F.max_by(F.struct("status", "degradation_reasons", "degraded"), "change").alias("s"))
    batch = spark.createDataFrame(log, schema)
    want = P.stage_state(batch.select("verification_id", "has_media").distinct(), batch.drop("has_media"))
    assert sorted(map(tuple, last.select("verification_id", "s.*").collect())) == sorted(map(tuple, want.drop("verdict_is_null").collect()))
    assert states[-1] <= 4


def test_many_keys_share_few_pieces_of_state(spark, tmp_path):
    # every key's events, whole in any type, by two buckets
    rows = [(f"k{k}", T0 + timedelta(seconds=600 * n), 2**53 + 10 * k + n if n else None, T0 + timedelta(microseconds=k)) for k in range(40) for n in range(3)]
    schema = "job_id string, ts timestamp, event_id long, seen timestamp"
    stream = machines.deliveries(landed(spark, tmp_path, rows, schema, 3, 7), 900, late="3 hours", buckets=2)
    got, states = left_over(spark, stream, tmp_path, "out")
    found = sorted(map(tuple, got.where("job_id <> 'clock'").select("job_id", "ts", "event_id", "seen").collect()), key=str)
    assert found == sorted((r for r in rows if r[1] != T0 + timedelta(seconds=600)), key=str)
    assert max(states) <= 2
