import random

import pytest

from claimloom import vocab as V
from claimloom.functions.scoring import CLAIM_RULES
from claimloom.operators import scores as S

EV = "claim_id string, evidence_id string, relationship string, relevance double, source_type string, is_primary boolean, temporal_factor double, directness double, cluster_id string"
CL = "claim_id string, claim_type string, is_satirical boolean"


def score(spark, items, claim_type="OTHER", satirical=False, penalties=()):
    rows = [("c", str(i), *it) for i, it in enumerate(items)]
    ev = spark.createDataFrame(rows, EV)
    cl = spark.createDataFrame([("c", claim_type, satirical)], CL)
    pen = spark.createDataFrame([("c", p) for p in penalties], "claim_id string, penalty_type string") if penalties else None
    return S.score_claims(cl, ev, pen).first()


def sup(n, cluster=None, relevance=0.9, kind="NEWS_ORGANIZATION", label="SUPPORTS", primary=False):
    return [(label, relevance, kind, primary, 1.0, 1.0, cluster)] * n


CASES = [
    ([], {}, 1), (sup(50, "x"), {}, 7), (sup(3), {}, 6), (sup(3), {"penalties": ["NUMERIC_MISMATCH"]}, 4),
    (sup(3), {"penalties": ["EXAGGERATION"]}, 5), (sup(3), {"claim_type": "OPINION"}, 2), (sup(3), {"satirical": True}, 3),
    (sup(3, label="CONTRADICTS"), {}, 8), (sup(1, label="CONTRADICTS"), {}, 9), (sup(1) + sup(1, label="CONTRADICTS"), {}, 10),
    (sup(5, label="NEUTRAL"), {}, 1), ([], {"claim_type": "OPINION"}, 1),
]


@pytest.mark.parametrize("items,options,rule", CASES)
def test_rules(spark, items, options, rule):
    got = score(spark, items, **options)
    assert got["decision_rule"] == rule
    assert got["verdict"] == CLAIM_RULES[rule]


@pytest.mark.parametrize("copies", [1, 5, 20, 50, 100])
def test_copies_are_one_origin(spark, copies):
    got = score(spark, sup(copies, "wire"))
    assert got["independent_origins"] == 1
    assert got["support_score"] == pytest.approx(0.9 + 0.15 * 0.9 * (copies - 1))
    assert got["verdict"] != "VERIFIED"


def test_values_are_clamped(spark):
    got = score(spark, [("SUPPORTS", 7.0, "OFFICIAL_GOVERNMENT", True, 3.0, 2.0, None)])
    assert got["support_score"] == pytest.approx(1.3)


def test_cluster_on_both_sides_counts_twice(spark):
    assert score(spark, sup(1, "k") + sup(1, "k", label="CONTRADICTS"))["independent_origins"] == 2


def model(items, penalty):
    """A plain restatement of the rules for one claim."""
    def side(name):
        groups = {}
        for i, (label, rel, kind, prim, temp, direct, cluster) in enumerate(items):
            if label == name:
                f = max(0.5, min(1.3, V.SOURCE_FACTORS[kind] + (0.15 if prim else 0)))
                groups.setdefault(cluster or i, []).append(max(0, min(1, rel)) * f * temp * direct)
        return sum(max(g) + 0.15 * (sum(g) - max(g)) for g in groups.values()), len(groups)

    (s, a), (c, b) = side("SUPPORTS"), side("CONTRADICTS")
    n, total = a + b, s + c
    net = (s - c) / total if total > 1e-9 else 0
    if total < 0.45 or n == 0:
        return 1
    if net >= 0.6 and penalty >= 0.35:
        return 4
    if net >= 0.6 and penalty > 0:
        return 5
    if net >= 0.75 and n >= 3 and s >= 2:
        return 6
    if net >= 0.5:
        return 7
    if net <= -0.75 and n >= 2 and c >= 1.5:
        return 8
    if net <= -0.4:
        return 9
    return 10 if s > 0 and c > 0 else 11


def test_random_claims_match_a_plain_model(spark):
    rng = random.Random(7)
    evidence, claims, want = [], [], {}
    for k in range(300):
        items = [
            (rng.choice(V.RELATIONSHIPS), rng.random(), rng.choice(V.SOURCE_TYPES), rng.random() < 0.2, rng.uniform(0.4, 1), rng.uniform(0.5, 1), rng.choice([None, "a", "b"]))
            for _ in range(rng.randrange(9))
        ]
        claims.append((str(k), "OTHER", False))
        evidence += [(str(k), f"{k}-{i}", *it) for i, it in enumerate(items)]
        want[str(k)] = model(items, 0.0)
    got = S.score_claims(spark.createDataFrame(claims, CL), spark.createDataFrame(evidence, EV)).collect()
    assert {r["claim_id"]: r["decision_rule"] for r in got} == want


def overall(spark, claims, degraded=False):
    rows = [("v", v, i, 0.8) for v, i in claims]
    sc = spark.createDataFrame(rows, "verification_id string, verdict string, importance double, confidence_score double")
    runs = spark.createDataFrame([("v", degraded)], "verification_id string, degraded boolean")
    r = S.score_overall(sc, runs).first()
    return r["overall_verdict"], r["decision_rule"], r["confidence_band"]


@pytest.mark.parametrize(
    "claims,want",
    [
        ([("FALSE", 0.9), ("VERIFIED", 0.9)], ("FALSE", 1)), ([("VERIFIED", 0.9), ("FALSE", 0.2)], ("VERIFIED", 5)),
        ([("MISLEADING", 0.5)], ("MISLEADING", 2)), ([("LIKELY_FALSE", 0.5)], ("LIKELY_FALSE", 3)), ([("SATIRE", 0.5)], ("SATIRE", 8)),
        ([("OPINION", 0.5)], ("OPINION", 8)), ([("PARTLY_TRUE", 0.5), ("OPINION", 0.5)], ("PARTLY_TRUE", 4)),
        ([("VERIFIED", 0.5), ("LIKELY_TRUE", 0.5)], ("LIKELY_TRUE", 6)), ([("UNVERIFIED", 0.5), ("VERIFIED", 0.5)], ("UNVERIFIED", 7)),
        ([("UNVERIFIED", 0.5), ("VERIFIED", 0.5), ("VERIFIED", 0.5)], ("PARTLY_TRUE", 4)),
    ],
)
def test_overall(spark, claims, want):
    assert overall(spark, claims)[:2] == want


def test_degraded_run_is_capped_and_empty_run_is_unverified(spark):
    assert overall(spark, [("VERIFIED", 0.9)])[2] == "HIGH"
    assert overall(spark, [("VERIFIED", 0.9)], True)[2] == "MEDIUM"
    runs = spark.createDataFrame([("w", False)], "verification_id string, degraded boolean")
    none = spark.createDataFrame([], "verification_id string, verdict string, importance double, confidence_score double")
    r = S.score_overall(none, runs).first()
    assert (r["overall_verdict"], r["decision_rule"], r["confidence_score"]) == ("UNVERIFIED", 0, 0.0)
