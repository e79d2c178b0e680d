"""Connected components and origin clusters over several kinds of link."""

import random

from pyspark.sql import functions as F

from claimloom.operators import links as N
from claimloom.operators import skew


def test_components_of_chains_stars_and_noise(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 30)
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 120)] + [(7, 7), (9000, 8000), (8000, 9000)]
    edges += [(1000 + pick.randrange(80), 1000 + pick.randrange(80)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert N.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_kinds_join_one_cluster(spark):
    rows = [
        (1, "https://w.org/a/", "h1", 0x3FF, "A long enough title of a report", "2024-01-05", "2024-02-01"),
        (2, "https://W.org/a", "h2", 0x3FF << 12, "Another title that nobody shares", None, "2024-01-01"),
        (3, None, "h2", 0x3FF << 40, "Third title that nobody else shares", "2024-01-02", "2024-02-01"),
        (4, "", None, (0x3FF << 40) + 3, "short", None, "2024-01-01"),
        (5, "", None, None, "a  LONG enough title of a report", None, "2024-01-01"),
        (6, None, None, None, "short", None, "2024-01-01"),
        (7, None, "h7", 0x3FF << 25, None, None, "2024-01-01"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, canonical_url string, content_hash string, simhash long, title string, published_at string, created_at string")
    docs = docs.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "created_at")})
    got = {r.doc_id: (r.cluster_id, r.joined_by) for r in N.linked_origins(docs).collect()}
    assert got == {1: (1, "url"), 2: (1, "url"), 3: (1, "hash"), 4: (1, "simhash"), 5: (1, "title")}
    one = N.linked_clusters(docs).collect()
    assert [(r.cluster_id, r.member_count, r.methods, r.representative_id) for r in one] == [(1, 5, "hash,simhash,title,url", 3)]
    assert N.linked_clusters(docs.limit(0)).collect() == []
