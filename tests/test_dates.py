"""Window overlaps and date penalties against plain loops."""

import random
from datetime import date, timedelta

from claimloom.operators import dates as N

DAY0 = date(2000, 1, 1)


def windows(seed, n):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        at = DAY0 + timedelta(days=pick.choice([pick.randrange(-40, 400), pick.randrange(-9000, 9000)]))
        out.append((i, at, at + timedelta(days=pick.choice([0, 0, 3, 20, 300, 5000, 40_000, -1]))))
    return out + [(900, None, DAY0), (901, DAY0, None), (902, date(1, 1, 1), date(9998, 1, 1))]


def shared(a, b):
    if None in a[1:] or None in b[1:] or a[1] > a[2] or b[1] > b[2]:
        return 0
    return (min(a[2], b[2]) - max(a[1], b[1])).days + 1


def test_overlaps_of_any_length(spark):
    left, right = windows(1, 70), windows(2, 80)
    got = N.overlapping(
        spark.createDataFrame(left, "a int, first_day date, last_day date"), spark.createDataFrame(right, "b int, first_day date, last_day date"), "a", "b"
    )
    want = sorted((x[0], y[0], shared(x, y)) for x in left for y in right if shared(x, y) > 0)
    assert sorted(map(tuple, got.collect())) == want


def test_penalties(spark):
    d = lambda n: DAY0 + timedelta(days=n)
    claimed = [(1, d(0), d(10)), (2, d(0), d(0)), (3, d(0), d(30)), (4, d(0), d(3)), (5, None, d(1)), (6, d(0), d(30)), (7, d(5), d(4))]
    found = [
        (1, d(4), d(9)), (2, d(1), d(1)), (2, d(90), d(91)), (3, d(5), d(6)), (3, d(8), d(9)), (4, d(5), d(9)), (4, d(-9), d(-2)),
        (5, d(0), d(0)), (6, d(5), d(6)), (6, d(40), d(41)), (7, d(4), d(4)), (8, d(0), d(0)), (1, d(9), None),
    ]
    schema = "claim_id int, first_day date, last_day date"
    args = spark.createDataFrame(claimed, schema), spark.createDataFrame(found, schema)
    assert sorted(map(tuple, N.date_penalties(*args).collect())) == [(3, "EXAGGERATION"), (4, "DATE_MISMATCH")]
    assert N.date_penalties(args[0], args[1].limit(0)).collect() == []


def test_penalties_weigh_on_verdicts(spark):
    """Strong support and an event dated wrongly: misleading, not verified."""
    from claimloom.operators import scores

    claims = spark.createDataFrame([(i, 1, i, "c", "FACTUAL", 0.9) for i in (1, 2)], "claim_id int, submission_id int, sequence int, claim_text string, claim_type string, importance double")
    items = [(c, f"{c}-{k}", k, "SUPPORTS", 0.9, "NEWS_AGENCY", True, None) for c in (1, 2) for k in range(4)]
    evidence = spark.createDataFrame(items, "claim_id int, evidence_id string, document_id int, relationship string, relevance double, source_type string, is_primary boolean, cluster_id string")
    schema = "claim_id int, first_day date, last_day date"
    claimed = spark.createDataFrame([(1, DAY0, DAY0), (2, DAY0, DAY0)], schema)
    found = spark.createDataFrame([(1, DAY0, DAY0), (2, DAY0 + timedelta(days=90), DAY0 + timedelta(days=90))], schema)
    got = {r.claim_id: (r.verdict, r.applied_penalty) for r in scores.score_claims(claims, evidence, N.date_penalties(claimed, found)).collect()}
    assert got[1][1] == 0.0 and got[1][0] != "MISLEADING" and got[2] == ("MISLEADING", 0.35)
