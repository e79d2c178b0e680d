import hashlib
import random
import re

import pytest

from claimloom.llm import contamination as C
from tests.llm.fixtures import SCHEMA, rows, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "One two, THREE four five six seven eight nine ten eleven twelve"),
    (10, "zz Yy xx"),  # shorter than a window
    (2, "été 日本 six"),
    (2, "a second text of item two"),
    (3, None),
    (4, ""),
    (5, "!?"),
    (None, "nameless test item of six words"),
    (6, "two three four five six seven eight nine ten eleven"),  # a window of item 1
]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(pairs, items, size):
    runs = {}
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in pairs:
        w = WORD.findall(low(t))
        hit, met = [False] * len(w), set()
        for n in {len(r) for r in runs}:
            for p in range(len(w) - n + 1):
                found = runs.get(tuple(w[p : p + n]))
                if found:
                    hit[p : p + n] = [True] * n
                    met |= found
        out.append((i, t, hit, sorted(met)))
    return out


def pairs():
    pick = random.Random(4)
    out = [(i, t) for i, t in texts(n=20)]
    for k in range(30):
        body = [pick.choice(["alpha", "beta", "Two", "THREE"]) for _ in range(pick.randint(0, 30))]
        whole = (pick.choice(ITEMS)[1] or "x").split()
        low_, high = sorted((pick.randrange(len(whole) + 1), pick.randrange(len(whole) + 1))) if k % 3 else (0, len(whole))
        at = pick.randrange(len(body) + 1)
        body[at:at] = whole[low_:high]
        out.append((2000 + k, pick.choice([" ", ", ", "\x00", "-\n"]).join(body)))
    out += [(5000, ITEMS[0][1].upper() + " " + ITEMS[0][1]), (None, "zz yy xx"), (None, None), (5001, ("zz yy xx " * 3 + "pad ") * 4000)]
    return out + [(5000, "another text of a repeated id, Zz-yy-XX"), (5002, "zz yy xx"), (5002, "zz yy xx"), (5003, "«zz yy xx»")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(pairs()), SCHEMA)


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def sorted_rows(found):
    return sorted(found, key=str)


@pytest.mark.parametrize("how", [{}, {"size": 3}, {"size": 3, "block_windows": 2}, {"block_bytes": 60}])
def test_digests_against_all_windows(docs, tests, how):
    got = [tuple(r) for r in C.digests(docs, tests, **how).collect()]
    want = [
        (i, len(hit), sum(hit), len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), any(hit))
        for i, _, hit, met in plain(pairs(), ITEMS, how.get("size", 10))
    ]
    assert sorted_rows(got) == sorted_rows(want)


def test_marked_keeps_columns(docs, tests):
    got = C.marked(docs, tests, out="rank")
    assert got.columns == [*[c for c in docs.columns if c != "rank"], "rank"]
    want = []
    for i, t, hit, met in plain(pairs(), ITEMS, 10):
        edges = [p for p in range(len(hit) + 1) if (p < len(hit) and hit[p]) != (p > 0 and hit[p - 1])]
        want.append((i, t, len(hit), sum(hit), list(zip(edges[::2], edges[1::2])), met))
    rows_ = [(r.doc_id, r.text, r.rank.n_words, r.rank.n_hit, [tuple(s) for s in r.rank.spans], r.rank["items"]) for r in got.collect()]
    assert sorted_rows(rows_) == sorted_rows(want)


def test_removed_spans_and_documents(docs, tests):
    found = plain(pairs(), ITEMS, 10)
    want = []
    for i, t, hit, _ in found:
        if any(hit):
            pieces = re.findall(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            assert len(pieces) == len(hit)
            at, kept = 0, ""
            for piece, gone in zip(pieces, hit):
                kept += "" if gone else t[at : at + len(piece)]
                at += len(piece)
            t = kept + t[at:]
        want.append((i, t))
    got = C.decontaminated(docs, tests)
    assert got.columns == docs.columns
    assert sorted_rows((r.doc_id, r.text) for r in got.collect()) == sorted_rows(want)
    left = C.decontaminated(docs, tests, remove="documents")
    assert left.columns == docs.columns
    assert sorted_rows((r.doc_id, r.text) for r in left.collect()) == sorted_rows((i, t) for i, t, hit, _ in found if not any(hit))
    with pytest.raises(ValueError):
        C.decontaminated(docs, tests, remove="words")


def test_empty_tables(docs, tests):
    assert C.digests(docs.limit(0), tests).collect() == []
    assert C.decontaminated(docs.limit(0), tests).collect() == []
    none = C.digests(docs, tests.limit(0))
    assert sorted_rows((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in none.collect()) == sorted_rows(
        (i, len(hit), 0, 0) for i, _, hit, _ in plain(pairs(), ITEMS, 10)
    )


def test_no_python_workers(docs, tests):
    plan = C.digests(docs, tests)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "Python" not in plan
