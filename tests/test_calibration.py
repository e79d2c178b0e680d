"""Isotonic fit against a plain pool-adjacent-violators pass."""

import random

import pytest

from claimloom.operators import calibration as N


def plain(rows):
    """[(low, high, n, rate)] by pooling from the left, score by score."""
    counts: dict[float, list[int]] = {}
    for s, y in rows:
        c = counts.setdefault(round(s, 6), [0, 0])
        c[0] += y
        c[1] += 1
    out: list[list] = []
    for s in sorted(counts):
        out.append([s, s, counts[s][1], counts[s][0]])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2] - 1e-15:
            _, high, n, p = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = high, out[-1][2] + n, out[-1][3] + p
    return [(a, b, n, p / n) for a, b, n, p in out]


@pytest.mark.parametrize("partitions, n", [(1, 50), (7, 4000), (4, 1)])
def test_fit_equals_plain_pooling(spark, partitions, n):
    pick = random.Random(n)
    rows = [(s, int(pick.random() < s**2)) for s in (pick.choice([pick.random(), round(pick.random(), 1)]) for _ in range(n))]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "score double, label int").repartition(partitions)
    got = sorted((r.low, r.high, r.n, r.rate) for r in N.isotonic(df).collect())
    want = plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))
    found = N.calibrated(df, N.isotonic(df)).collect()
    for r in found:
        if r.score is None:
            assert r.rate is None
        else:
            assert r.rate == pytest.approx(max([w[3] for w in want if w[0] <= round(r.score, 6)], default=want[0][3]))


def test_bins_and_empty(spark):
    rows = [("TRUE", 0.95, 1), ("TRUE", 1.0, 0), ("TRUE", 0.05, 0), ("FALSE", 0.95, 1), ("FALSE", None, 1)]
    df = spark.createDataFrame(rows, "verdict string, score double, label int")
    got = {(r.verdict, r.bin): (r.n, round(r.mean_score, 6), r.rate, round(r.gap, 6)) for r in N.reliability(df).collect()}
    assert got == {("TRUE", 9): (2, 0.975, 0.5, -0.475), ("TRUE", 0): (1, 0.05, 0.0, -0.05), ("FALSE", 9): (1, 0.95, 1.0, 0.05)}
    assert N.isotonic(df.limit(0)).collect() == [] and N.reliability(df.limit(0)).collect() == []
