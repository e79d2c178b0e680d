import pytest

from claimloom.llm import jaccard_join, substrings
from claimloom.llm.graph import components
from claimloom.llm.jaccard_join import Region, cells, shingle_sets
from tests.llm import brute
from tests.llm.fixtures import frame, texts

PAIRS = texts() + [(3, "later text of a repeated id that is long enough"), (None, "nameless words here"), (None, None)]


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"region_shingles": 40, "block": 2}])
def test_linked_against_all_pairs(spark, how):
    got = jaccard_join.linked(frame(spark, PAIRS), words=3, num=70, den=100, **how)
    assert listed(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(PAIRS, 3, 70, 100), key=str)


def test_passages_of_middling_frequency_do_not_chain(spark):
    """Documents that share a passage with others, and copies among them: parted by rarest shingles, nothing is lost."""
    import random

    pick = random.Random(6)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(8)]
    pairs = []
    for i in range(120):
        own = [f"u{i}y{j}" for j in range(40)] if i % 4 else pairs[pick.randrange(len(pairs))][1].split() if pairs else ["a"]
        if i % 4:
            own[pick.randrange(40)] += " " + passages[i % 8] + " " + passages[pick.randrange(8)]
        else:
            own[pick.randrange(len(own))] = f"changed{i}"
        pairs.append((i, " ".join(own)))
    got = jaccard_join.linked(frame(spark, pairs), words=3, num=80, den=100, loose=100)
    assert listed(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(pairs, 3, 80, 100), key=str)


def test_one_of_each_keeps_columns(spark):
    docs = frame(spark, texts())
    kept = jaccard_join.one_of_each(docs)
    want = [i for i, _, c in brute.components(texts(), 5, 80, 100) if i == c]
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_tables(spark):
    docs = frame(spark, PAIRS).limit(0)
    assert jaccard_join.linked(docs).collect() == []
    assert substrings.digests(docs).collect() == []
    assert substrings.stripped(docs).collect() == []


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 40)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 40, 40: 40}


def test_cells_lose_no_pair():
    """Random sets at and around the threshold, small ones included: linked pairs share a key."""
    import numpy as np

    pick = np.random.default_rng(3)
    for num in (80, 90):
        for _ in range(400):
            n = int(pick.integers(1, 80))
            a = np.unique(pick.integers(0, 1 << 62, n).astype(np.uint64))
            b = a[pick.random(len(a)) > pick.choice([0.03, 0.1, 0.2])]
            b = np.unique(np.append(b, pick.integers(0, 1 << 62, int(pick.integers(0, 1 + n // 8))).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                for share in (0.0, 0.5, 0.9, 1.0):
                    common = np.sort(pick.permutation(np.append(a, b))[: int(share * (len(a) + len(b)))])
                    keys, of = cells([a, b], num, 100, common)
                    assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_region_joins_recursively():
    """A region of many loose documents: Voronoi cells with windows find what all pairs find."""
    import numpy as np

    pick = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = pick.integers(0, 3000, 60)
        for _ in range(12):
            own = base.copy()
            own[pick.integers(0, 60, int(pick.integers(0, 6)))] = pick.integers(0, 3000)
            sets.append(np.unique(own).astype(np.uint64))
    region = Region(list(range(len(sets))), sets, 80, 100)
    region.join(np.arange(len(sets)))
    plain = list(range(len(sets)))

    def top(i):
        while plain[i] != i:
            i = plain[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                plain[y] = x
    same = {}
    for i in range(len(sets)):
        assert same.setdefault(int(region.of[i]), top(i)) == top(i)
    assert len(same) == len({top(i) for i in range(len(sets))})


def test_shingles_of_bytes():
    import numpy as np

    raw = [t or "" for _, t in PAIRS]
    data = "".join(raw).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in raw])
    got = shingle_sets(np.frombuffer(data, np.uint8), ends, 3)
    assert [len(s) for s in got] == [len(brute.shingles(t, 3)) for t in raw]


@pytest.mark.parametrize("hot, places", [(1000, 1500), (2, 1500), (5, 7)])
def test_digests_against_all_windows(spark, hot, places, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_PLACES", hot)
    monkeypatch.setattr(substrings, "SHARD_PLACES", places)
    got = substrings.digests(frame(spark, PAIRS), window=10, gram=4)
    want = [(i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.stripped(PAIRS, 10)]
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)


def test_pieces_do_not_grow_with_partitions(spark):
    """A row per piece, however many shards and tasks there are."""
    import pyarrow as pa

    rng = __import__("random").Random(1)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    texts_ = [f"a{i} {passage} b{i}" for i in range(50)]
    places = [[{"place": p, "hot": hot} for p in range(60)] for hot in (True, False) for _ in range(25)]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(50)), "text": texts_, "places": pa.array(places, pa.list_(pa.struct([("place", pa.int64()), ("hot", pa.bool_())])))}
    )
    rows = [sum(b.num_rows for b in substrings._cut_pieces(20, 6, shards)(iter([batch]))) for shards in (8, 64, 4096)]
    assert rows[0] == rows[1] == rows[2] < 50 * 40


def test_stripped_texts(spark):
    docs = frame(spark, texts())
    got = substrings.stripped(docs)
    assert got.columns == docs.columns
    plain = dict(texts())
    want = {i: (kept if gone else plain[i]) for i, _, gone, kept in brute.stripped(texts(), 20)}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_automaton_reads_off_earlier_suffixes():
    import random

    pick = random.Random(2)
    automaton, before = substrings.SuffixAutomaton(), []
    for _ in range(12):
        automaton.restart()
        text = [pick.choice("ab") for _ in range(25)]
        for i in range(len(text)):
            got = automaton.add(text[i])
            earlier = [*before, text[:i]]  # ends before this place
            own = text[: i + 1]
            longest = 0
            for n in range(1, i + 2):
                tail = own[-n:]
                if any(tail == e[j : j + n] for e in earlier for j in range(len(e) - n + 1)):
                    longest = n
            assert got == longest
        before.append(text)
