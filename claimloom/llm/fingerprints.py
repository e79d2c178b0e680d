"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets are taken from a window of five bytes that slides over a text's UTF-8 bytes; each is
hashed to one of 256 buckets and counted.  The digest holds, per bucket, in which quartile of all
buckets its count lies (two bits), and the text's length on a logarithmic scale.  Two digests are
compared by a difference score with an upper bound, given as a likeness between 0 and 1.

`with_next` deals rows by ranges of the id, so that a document and the one that follows lie in one
task, and emits the first and last document of each task apart; those few are joined afterwards.

Defined cases: a null text counts as empty; an empty text, or one under three bytes, has a digest of
zero counts; a null id sorts first; rows that repeat an id follow one another by text; a table of
one row follows itself; very long texts are counted whole, in steps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.llm.shared import tasks, written

BUCKETS = 256
#: Places of the second and third byte of a triplet behind the first.
TRIPLETS = ((1, 3), (2, 4))
#: Cost of buckets whose quartiles lie 0, 1, 2 or 3 apart.
COSTS = np.array([0, 1, 3, 6])
#: Difference at which two digests count as wholly unlike.
UNLIKE = 512
_STEP = 1 << 20


def _counts(data: np.ndarray) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 0), _STEP):  # windows are cut into steps, not lost
        part = data[at : at + _STEP + 4].astype(np.uint32)
        for kind, (i, j) in enumerate(TRIPLETS):
            n = min(len(part) - j, _STEP)
            if n <= 0:
                continue
            h = part[:n] * np.uint32(0x9E3779B1) + part[i : i + n] * np.uint32(0x85EBCA6B) + part[j : j + n] * np.uint32(0xC2B2AE35)
            h = (h + np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x165667B1)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def fingerprint(text: str) -> str:
    """Two hex digits of length, then two bits per bucket, in hex."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    counts = _counts(data)
    ordered = np.sort(counts)
    quartile = sum((counts > ordered[BUCKETS * q // 4 - 1]).astype(np.uint8) for q in (1, 2, 3))
    length = min(255, round(12 * math.log2(len(data) + 1)))
    packed = quartile.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, never over 6 * 256 + 255."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    spread = lambda d: ((d[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).astype(np.int64)
    return int(COSTS[np.abs(spread(x) - spread(y))].sum()) + abs(int(x[0]) - int(y[0]))


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / UNLIKE)


def edited(text: str, after: str) -> str:
    """text, its last quarter replaced by as many first code points of the text after it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_EDGE = _SCHEMA.append(pa.field("task", pa.int64())).append(pa.field("side", pa.int32())).append(pa.field("text", pa.string()))


def _row(doc_id, text: str, own: str, after: str, next_print: str) -> tuple:
    new = edited(text, after)
    changed = fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8")).hexdigest()
    return doc_id, len(text), sha, own, changed, likeness(own, changed), likeness(own, next_print)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per: int = 4) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and how near both and the next one's are."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = texts.repartitionByRange(tasks(docs.sparkSession) * per, "doc_id").sortWithinPartitions("doc_id", "text")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        edge = lambda side, doc: (doc[0], None, None, doc[2], None, None, None, task, side, doc[1])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = (doc_id, text, fingerprint(text))
                out.append((*_row(*held, text, doc[2]), None, None, None) if held else edge(0, doc))
                held = doc
            yield _batch(out, _EDGE)
        if held:
            yield _batch([edge(1, held)], _EDGE)

    found = written(ranged.mapInArrow(inside, f"{_ROW}, task long, side int, text string"), "fingerprints")
    names = _SCHEMA.names
    edges = found.where("side is not null")
    # at most two rows a task, without their texts
    order = W.orderBy(F.col("doc_id").asc_nulls_first(), "task", "side")
    follow = edges.select("doc_id", "task", "side").withColumn("after", F.lead("task").over(order)).where("side = 1")
    firsts = edges.where("side = 0").select(F.col("task").alias("after"), F.col("text").alias("after_text"), F.col("fingerprint").alias("after_print"))
    first = edges.where("side = 0").orderBy(F.col("doc_id").asc_nulls_first(), "task").select("task").head()
    lasts = (
        edges.where("side = 1").select("doc_id", "text", "fingerprint", "task")
        .join(follow.select("task", "after"), "task")
        .withColumn("after", F.coalesce("after", F.lit(first and first.task)))  # the first follows the last
        .join(firsts, "after")
        .select("doc_id", "text", "fingerprint", "after_text", "after_print")
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row(*r.values()) for r in batch.to_pylist()], _SCHEMA)

    return found.where("side is null").select(*names).unionByName(lasts.mapInArrow(across, _ROW))
