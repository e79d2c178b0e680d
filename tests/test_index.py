"""The kept corpus index against fresh builds and plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import declared as D
from claimloom.operators import vector_index as VI
from claimloom.operators.corpus_index import CorpusIndex, build
from claimloom.session import run_folder


def texts(n=150, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    out = [(i, " ".join(pick.choices(words, weights, k=pick.choice([0, 5, 40, 200])))) for i in range(n)]
    return out + [(1000, None), (1001, ""), (1002, "W1 w1, w2 \u0995\u09be-w3!"), (1003, "w119 " * 500)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(spark, rows):
    return frame(spark, [(i, t or "") for i, t in rows])


def same(a, b, digits=6):
    def key(r):
        return tuple(round(x, digits) if isinstance(x, float) else x for x in r)

    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def state(index):
    return {
        "terms": sorted(map(tuple, index.blocks().groupBy("term").agg(F.sum("n").alias("n")).collect())),
        "postings": sorted(map(tuple, index.postings().collect())),
        "documents": sorted((r.doc_id, r.length, tuple(r.tokens), tuple((t.term, t.tf) for t in r.terms)) for r in index.documents().collect()),
        "count": index.count(),
    }


@pytest.fixture(scope="module")
def whole(spark):
    """(index after additions, replacements, removals; one built afresh of what is left)."""
    rows = texts()
    grown = build(spark, run_folder(spark, "ix"), [frame(spark, rows[:100]), frame(spark, [(i, "w1 other " + str(i)) for i in range(20, 40)])])
    grown.add(frame(spark, rows[20:40] + rows[100:]))
    grown.add(frame(spark, [(5000, "soon gone w1 w2")]))
    grown.remove(frame(spark, [(5000, ""), (3, ""), (3, ""), (777_777, "")]))
    fresh = build(spark, run_folder(spark, "ix"), [frame(spark, [r for r in rows if r[0] != 3])])
    return grown, fresh, [r for r in rows if r[0] != 3]


def test_generations_equal_a_fresh_build(whole):
    grown, fresh, rows = whole
    assert state(grown) == state(fresh) and grown.count() == len(rows)


def test_compaction_keeps_all(spark, whole):
    grown, fresh, _ = whole
    before = state(grown)
    gen = grown.compact()
    assert state(grown) == before and [r["gen"] for r in grown.commits()] == [gen]


@pytest.mark.parametrize("k", [1, 10, 60, 1000])
def test_best_documents_are_those_of_all(spark, whole, k):
    grown, _, rows = whole
    pick = random.Random(9)
    asked = [(i, " ".join(f"w{pick.randrange(130)}" for _ in range(pick.choice([1, 4, 12])))) for i in range(12)] + [(50, ""), (51, "w1"), (52, "nowhere")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    assert same(grown.keyword_leg(queries, k), D.keyword_leg(queries, plain(spark, rows), k))


def test_search_is_ranked(spark, whole):
    grown, _, rows = whole
    found = {r.doc_id: r.score for r in grown.search(["W1", "w2"]).collect()}
    assert set(found) == {r.doc_id for r in D.search(plain(spark, rows), ["W1", "w2"]).collect()}
    assert grown.search(["w1", "nowhere"]).collect() == []


def test_bounds_spare_most_postings(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(["the", "of", "and"] * pick.randint(1, 6) + [f"r{pick.randrange(400)}" for _ in range(6)])) for i in range(3000)]
    index = build(spark, run_folder(spark, "ix"), [frame(spark, rows)])
    queries = spark.createDataFrame([(i, f"the of and r{i} r{i + 7} r{i + 90}") for i in range(10)], "query_id long, text string")
    seen: dict = {}
    got = index.keyword_leg(queries, 5, trace=seen)
    assert same(got, D.keyword_leg(queries, frame(spark, rows), 5))
    assert seen["seeds"] + seen["joined"] < 10 * 3 * 3000 / 10


def test_adding_reads_only_what_is_added(spark):
    """The rows that an addition cuts into tokens are the added ones, by a count taken as they are read."""
    index = build(spark, run_folder(spark, "ix"), [frame(spark, texts())])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    delta = frame(spark, [(2, "w1 w2"), (9000, "w3")]).mapInArrow(counted, "doc_id long, text string")
    files = {f for f in index.documents().inputFiles()}
    index.add(delta)
    assert read.value == 2 and index.count() == len(texts()) + 1
    assert files <= set(index.documents().inputFiles())  # nothing was written anew


def test_faults_and_empty_index(spark):
    index = CorpusIndex(spark, run_folder(spark, "ix"))
    queries = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert index.count() == 0 and index.documents().collect() == [] and index.search(["w1"]).collect() == []
    assert index.keyword_leg(queries).collect() == []
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            index.add(frame(spark, rows))
    index.add(frame(spark, []))
    assert index.count() == 0 and index.keyword_leg(queries).collect() == []


# ---- vectors ---------------------------------------------------------------------------


def vectors(n=1500, dims=16, seed=2):
    pick = np.random.default_rng(seed)
    middles = pick.normal(0, 1, (12, dims))
    rows = [(i, (middles[i % 12 if i % 3 else 0] + pick.normal(0, 0.05, dims)).tolist()) for i in range(n)]
    rows += [(10_000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(20_000, None), (20_001, [0.0] * dims), (20_002, [1.0] * 3), (20_003, [float("nan")] * dims), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("block, part, k", [(2048, 16_384, 10), (3, 50, 10), (2048, 16_384, 700)])
def test_cells_find_what_all_rows_give(spark, monkeypatch, block, part, k):
    monkeypatch.setattr(VI, "BLOCK", block)
    monkeypatch.setattr(VI, "PART", part)
    rows = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.unionByName(spark.createDataFrame([(-1, [0.0] * 16), (-2, [1.0, -1.0] * 8), (-3, None)], "query_id long, embedding array<double>"))
    index = VI.VectorIndex(spark, run_folder(spark, "vx")).build(rows.where("vec_id < 1000"))
    index.add(rows.where("vec_id >= 1000 OR vec_id IS NULL"), number=1)
    seen: dict = {}
    fine = rows.where("vec_id IS NOT NULL AND vec_id <> 20003")
    got = index.topk(asked, k, trace=seen).where("vec_id IS NOT NULL")
    want = D.vector_topk(asked, fine.unionByName(rows.where("vec_id IS NULL").withColumn("vec_id", F.lit(1 << 60))), k)
    columns = ["query_id", "vec_id", "similarity", "rank"]
    assert same(got.select(columns), want.where(F.col("vec_id") < 1 << 60).select(columns), 8)
    if k == 10:
        assert seen["scored"] < 0.5 * seen["pairs"] and seen["rounds"] >= 1


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = VI.VectorIndex(spark, run_folder(spark, "vx")).build(none, dims=4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert index.topk(asked).collect() == []


def test_term_counts_on_the_row(spark):
    from claimloom.operators.corpus_index import term_counts

    rows = [(0, ["b", "a", "b", "ক", "B", "b"]), (1, []), (2, ["x"]), (3, ["y"] * 300)]
    got = spark.createDataFrame(rows, "id long, w array<string>").select("id", term_counts(F.col("w")).alias("t")).collect()
    assert {r["id"]: [tuple(t) for t in r["t"]] for r in got} == {i: sorted((x, w.count(x)) for x in set(w)) for i, w in rows}


def test_held_counts_without_replaced_documents(spark):
    rows = texts()
    index = build(spark, run_folder(spark, "index"), [plain(spark, rows[:120]), plain(spark, [(i, "other words here") for i in range(40)]), plain(spark, rows[:40] + rows[120:])])
    want = index.postings().groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))
    assert same(index.held(), want)
    words = {r["doc_id"]: r["words"] for r in index.held().collect()}
    assert words == {r["doc_id"]: r["length"] for r in index.documents().collect() if r["length"]}


def test_add_shuffles_texts_and_not_words(spark):
    """Of an added text the words are counted on the row: no sorting or joining by document."""
    index = CorpusIndex(spark, run_folder(spark, "index"))
    plans = []
    put = CorpusIndex._put

    def noted(self, df, kind, gen, part=None):
        plans.append((kind, df._jdf.queryExecution().executedPlan().toString()))
        return put(self, df, kind, gen, part)

    CorpusIndex._put = noted
    try:
        index.add(plain(spark, texts()))
    finally:
        CorpusIndex._put = put
    written = dict(plans)["documents"]
    assert "Join" not in written and "Aggregate" not in written
    assert index.count() == len(texts())


def test_keyword_leg_sums_where_documents_are(spark):
    docs = plain(spark, texts())
    queries = spark.createDataFrame([(1, "w0 w1 w5"), (2, "w2 w119"), (3, None)], "query_id long, text string")
    found = D.keyword_leg(queries, docs, k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not any(
        "query_id" in line and "doc_id" in line for line in plan.splitlines() if "hashpartitioning" in line
    )
    index = build(spark, run_folder(spark, "index"), [docs])
    assert same(found.select("query_id", "doc_id", "score", "rank"), index.keyword_leg(queries, 5))


def test_simhash_takes_few_lists_at_a_time(monkeypatch):
    import hashlib

    import pyarrow as pa

    pick, sizes, whole = random.Random(2), [], D._hash_lists
    monkeypatch.setattr(D, "HASHED_ROWS", 7)
    monkeypatch.setattr(D, "_hash_lists", lambda t: (sizes.append(len(t)), whole(t))[1])
    rows = [None, []] + [[pick.choice("abcdefg") for _ in range(pick.randrange(30))] for _ in range(40)] + [None]

    def bits(words):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words or []]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(D.HASH_BITS))

    assert D._simhash.func(pa.array(rows, pa.list_(pa.string()))).to_pylist() == [bits(r) for r in rows]
    assert max(sizes) == 7 and sum(sizes) == len(rows)
