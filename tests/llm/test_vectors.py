"""Centroid clustering and hard negatives against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import centroids as C
from claimloom.llm import hard_negatives as H

DIRTY = [None, [], [0.5] * 3, [0.5] * 7 + [None], [0.5] * 7 + [float("nan")], [0.5] * 7 + [float("inf")], [0.5] * 9]
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, whole int, id int, distance int"


def vectors(n=120, dims=8, seed=5):
    pick = np.random.default_rng(seed)
    middles = pick.normal(0, 0.4, (6, dims))
    out = [(int(i * 3), (middles[i % 5 if i % 3 else 0] + pick.normal(0, 0.05, dims)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    out += [(10_000 + i, out[0][1], 0) for i in range(40)]  # many copies of one vector
    out += [(20_000 + i, v, 1) for i, v in enumerate(DIRTY)]
    out += [(out[5][0], out[6][1], 2), out[7], (None, out[8][1], 1), (-50, out[9][1], 3), (30_000, out[1][1], None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


def whole(v):
    return [math.floor(256 * x) for x in v]


def plain(rows, k, dims, rounds, seed=2):
    held = [(i, whole(v)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), w) for i, w in held if i is not None)
    middles = [w for _, w in order[:k]]

    def near(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, w in held:
            groups.setdefault(near(w)[1], []).append(w)
        middles = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(middles)]
    found = [(i, *near(w)) for i, w in held]
    return [
        (i, j, d, sum(e for _, e, c in found if c == j), sum(e for _, e, _ in found), hashlib.sha256(",".join(map(str, middles[j])).encode()).hexdigest())
        for i, d, j in found
    ]


@pytest.mark.parametrize("k, rounds", [(7, 3), (1, 1), (40, 2), (500, 1)])
def test_clusters_against_all_distances(spark, k, rounds):
    got = C.digests(frame(spark, vectors()), k=k, dims=8, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain(vectors(), k, 8, rounds), key=str)


def test_clustered_keeps_columns(spark):
    docs = frame(spark, vectors())
    found, middles = C.clustered(docs, k=5, dims=8)
    assert found.columns == [*[c for c in docs.columns if c not in ("cluster", "distance")], "cluster", "distance"]
    assert middles.shape == (5, 8) and found.count() == len(plain(vectors(), 1, 8, 0))


def test_empty_and_too_large(spark):
    docs = frame(spark, vectors())
    assert C.digests(docs.limit(0)).collect() == []
    assert C.digests(docs, dims=5).collect() == []
    with pytest.raises(Exception, match="over"):
        C.digests(frame(spark, [(1, [1e30] * 8, 0)]), dims=8).collect()


def test_walks_stop_early_and_keep_ties():
    pick = np.random.default_rng(0)
    middles = pick.integers(-500, 500, (60, 3))
    middles[40:] = middles[:20]  # ties go to the smaller number
    x = np.vstack([pick.integers(-500, 500, (300, 3)), middles])
    who, far, met = C.Lists(middles).nearest(x)
    every = ((x[:, None] - middles[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (far == every.min(1)).all()
    assert met.mean() < 30


def plain_negatives(rows, positives=5, negatives=3):
    held = [(i, whole(v), label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, x, label) in enumerate(held):
        if anchor % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for b, (i, y, other) in enumerate(held) if b != a and len(x) == len(y))
        for s, positive, _ in [r for r in scored if r[2]][:positives]:
            band = [r for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(anchor, positive, k, i, -s, -t) for k, (t, i, _) in enumerate(band, 1)]
    return out


@pytest.mark.parametrize("block, groups, count", [(4096, 2, 3), (3, 1, 1), (2, 5, 2)])
def test_negatives_against_all_pairs(spark, monkeypatch, block, groups, count):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "GROUPS", groups)
    rows = vectors(n=200) + [(50_000, [0.0] * 8, 1), (60_000, [-3.0] * 8, 1), (-100, [], 1), (-150, [], 2)]
    got = H.mined(frame(spark, rows), anchor=F.col("vec_id") % 50 == 0, count=count)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_negatives(rows))


def test_negatives_of_empty_tables(spark):
    docs = frame(spark, vectors())
    assert H.mined(docs.limit(0)).collect() == []
    assert H.mined(docs, anchor=F.lit(False)).collect() == []


@pytest.mark.parametrize("count", [1, 2, 4])
def test_intervals_hold_scores_and_spare_most(count):
    pick = np.random.default_rng(3)
    middles = pick.normal(0, 0.3, (10, 64))
    label = pick.integers(0, 10, 3000)
    x = np.floor(256 * (middles[label] + pick.normal(0, 0.1, (3000, 64)))).astype(np.int64)
    x[:20] = 0
    x[20:40] = x[60]
    words, facts = H.codes(x, count)
    low, high = H.Anchors(x[:100]).intervals(slice(0, 100), words, facts)
    true = x[:100] @ x.T
    assert (low <= true).all() and (true <= high).all()
    own = {"row": np.arange(3000), "id": np.arange(3000), "label": np.arange(3000) % 2, "whole": x, "words": words, "facts": facts}
    found = H.Positives(H.Rows(own), 5)
    found.meet(H.Rows(own))
    if count == 4:
        assert found.scored < found.seen / 2
