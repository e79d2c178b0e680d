import hashlib
import re

from pyspark.sql import functions as F

from claimloom.llm.exact_dedup import copies, deduplicated

ROWS = [
    (5, "a  b\n c", 1), (2, "a b c", 2), (9, None, 3), (7, "", 4), (4, "x" * 40, 5), (3, "x" * 40, 6), (8, "x" * 39, 7),
    (6, "x" * 40 + " y", 8), (6, "x" * 40 + "\t y", 9), (None, "a b c", 10), (1, " a b c", 11), (2, "a b c", 12),
]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), t in zip(rows, norm):
        ids = [r[0] for r, n in zip(rows, norm) if n == t]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.sha) for r in df.collect()), key=str)


def test_small_blocks_many_levels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, name int")
    found = copies(docs, block_bytes=4)
    assert got(found) == brute(ROWS)
    assert found.where("kept").count() == len({b[3] for b in brute(ROWS)})


def test_digest_collisions_are_told_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, name int")
    assert got(copies(docs, block_bytes=4, digest=lambda b: F.xxhash64(b) % 2)) == brute(ROWS)


def test_deduplicated_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, name int")
    kept = deduplicated(docs, block_bytes=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert copies(docs).collect() == [] and deduplicated(docs).collect() == []
