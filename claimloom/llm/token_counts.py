"""Token counts of documents in flat token files that have no index.

A flat file is one run of token ids of fixed width, documents ended by an end-of-document id.  Files
are held as numbered blocks of bytes.  Each block is scanned on its own with numpy: places of the
separators give the lengths of the documents inside it, and a summary row (separators, tokens before
the first, tokens after the last).  A prefix scan over the summaries then numbers the documents of
each file across its blocks and joins the open ends: a document that begins in one block and ends in
another is as long as the tail of the first, all blocks without a separator between, and the head of
the last.  The scan has two levels (blocks in groups, groups in a file), so no task holds more than a
group of one file or the groups of a file.

Defined cases: a null text is a document of no tokens; an empty file has no documents; tokens after
the last separator are a document of their own (`open`); separators side by side are documents of no
tokens; a block before the last of its file that does not hold a whole number of ids is an error; an id that is too large
for the file's width is an error; rows that repeat an id are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.llm.shared import written
from claimloom.llm.tokens import default_files, encode
from claimloom.session import cut_lineage

WIDTH = 2
END_ID = 50256
BLOCK_BYTES = 1 << 18
#: Bytes of a plain file that one task reads, and the most such tasks (of several ranges each, if there are more).
RANGE_BYTES = 1 << 26
MOST_TASKS = 20_000
GROUP = 1024

_FILE = "file string, block long, bytes binary, ordinal long, doc_id long"


def _narrow(ids: np.ndarray, kind) -> np.ndarray:
    """ids as numbers of a file's width."""
    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
        raise ValueError(f"an id of {int(ids.max())} does not fit into {np.dtype(kind).itemsize} bytes")
    return ids.astype(kind)


def flat_files(docs: DataFrame, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
               files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents tokenised into one flat file a task, written to the shared folder: rows with bytes are
    blocks (file, block, bytes), rows without list which document is which (file, ordinal, doc_id)."""
    _whole(block_bytes, width)
    files = files or default_files()
    kind = np.dtype(f"<u{width}")

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"tokens-{TaskContext.get().partitionId():06d}"
        block, ordinal, rest = 0, 0, b""

        def rows(blocks: list[bytes], ids: list) -> pa.RecordBatch:
            b, d = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (b + d)),
                    pa.array([*range(block, block + b), *[None] * d], pa.int64()),
                    pa.array([*blocks, *[None] * d], pa.binary()),
                    pa.array([*[None] * b, *range(ordinal, ordinal + d)], pa.int64()),
                    pa.array([*[None] * b, *ids], pa.int64()),
                ],
                ["file", "block", "bytes", "ordinal", "doc_id"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, ids = part.column(1), part.column(0).to_pylist()
                data = rest + b"".join(_narrow(np.append(encode(t.as_py() or "", files), end_id), kind).tobytes() for t in texts)
                whole = len(data) // block_bytes
                cut = [data[i * block_bytes : (i + 1) * block_bytes] for i in range(whole)]
                rest = data[whole * block_bytes :]
                yield rows(cut, ids)
                block, ordinal = block + whole, ordinal + len(ids)
        if rest:
            yield rows([rest], [])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(flatten, _FILE), "tokens")


def _whole(block_bytes: int, width: int) -> None:
    if block_bytes <= 0 or block_bytes % width:
        raise ValueError(f"blocks of {block_bytes} bytes don't hold a whole number of ids of {width} bytes")


def _opened(path: str):
    """A file of a store, to be read from any place."""
    if re.match(r"file:/|/", path):
        return open(unquote(re.sub(r"^file:/+", "/", path)), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return store.open_input_file(name)


def blocks_of(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> DataFrame:
    """(file, block, bytes) of flat files of any size in a folder.  Spark lists the files; a task reads a
    range of about `RANGE_BYTES` of one, opening it itself (as a local file, or by pyarrow.fs)."""
    _whole(block_bytes, width)
    many = max(1, RANGE_BYTES // block_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as held:
                    held.seek(row["first"] * block_bytes)
                    end = min(row["length"], (row["first"] + many) * block_bytes)
                    for block, at in enumerate(range(row["first"] * block_bytes, end, block_bytes), row["first"]):
                        part, size = held.read(min(block_bytes, end - at)), min(block_bytes, end - at)
                        if len(part) != size:
                            raise OSError(f"{row['path']} has changed: {len(part)} of {size} bytes at {at}")
                        yield pa.RecordBatch.from_pydict({"file": [row["path"]], "block": [block], "bytes": [part]})

    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes).cast("long"), F.lit(many).cast("long"))
    ranges = cut_lineage(listed.select("path", "length", F.explode(starts).alias("first")))
    dealt = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))
    return dealt.mapInArrow(cut, "file string, block long, bytes binary")


_SCAN = "file string, block long, size long, seps long, head long, tail long, at long, inner array<long>"


def _scan(end_id: int, width: int):
    """Per block: separators, ids before the first and after the last (all ids when there is none), and
    the lengths between; ids that a block's edge cuts are left to `at`, which must be 0."""
    kind = np.dtype(f"<u{width}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, block, data in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("bytes")):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                ids = raw[: len(raw) // width * width].view(kind)
                place = np.flatnonzero(ids == end_id)
                head = int(place[0]) if len(place) else len(ids)
                tail = len(ids) - int(place[-1]) - 1 if len(place) else len(ids)
                out.append((name, block, len(ids), len(place), head, tail, len(raw) % width, (np.diff(place) - 1).tolist()))
            columns = zip(*out) if out else [[]] * 8
            types = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _SCAN.split(", ")])

    return scan


def lengths(blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens, open) of every document of the files; blocks (file, block, bytes) hold a
    whole number of ids, all but the last of a file."""
    scanned = written(blocks.select("file", "block", "bytes").mapInArrow(_scan(end_id, width), _SCAN), "scan")
    odd = scanned.groupBy("file").agg(F.max("block").alias("last"), F.min(F.when(F.col("at") != 0, F.col("block"))).alias("odd"))
    for row in odd.where("odd < last").limit(1).collect():
        raise ValueError(f"block {row['odd']} of {row['file']} is not its last and holds no whole number of ids")
    grouped = scanned.withColumn("grp", F.floor(F.col("block") / GROUP))
    # a group in short: its separators, and the open tail behind its last one
    in_group = W.partitionBy("file", "grp").orderBy("block")
    so_far = in_group.rowsBetween(W.unboundedPreceding, -1)
    # `since` counts the blocks' tails since the last separator: the running size less its value there
    run = grouped.withColumn("before", F.coalesce(F.sum("seps").over(so_far), F.lit(0))).withColumn("size_before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    mark = F.when(F.col("seps") > 0, F.col("size_before") + F.col("size") - F.col("tail"))
    run = run.withColumn("mark", mark).withColumn("last_mark", F.max("mark").over(so_far))
    groups = run.groupBy("file", "grp").agg(F.sum("seps").alias("g_seps"), F.sum("size").alias("g_size"), F.max("mark").alias("g_mark"))
    over_groups = W.partitionBy("file").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    groups = (
        groups.withColumn("g_before", F.coalesce(F.sum("g_seps").over(over_groups), F.lit(0)))
        .withColumn("g_start", F.coalesce(F.sum("g_size").over(over_groups), F.lit(0)))
        .withColumn("g_last", F.max(F.col("g_start") + F.col("g_mark")).over(over_groups))
        .select("file", "grp", "g_before", "g_start", "g_last")
    )
    placed = run.join(groups, ["file", "grp"]).select(
        "file", "block", "size", "seps", "head", "tail", "inner",
        (F.col("g_before") + F.col("before")).alias("first"),
        (F.col("g_start") + F.col("size_before")).alias("start"),
        # where the document that is open at the block's start began, in ids from the file's start
        F.coalesce(F.col("g_start") + F.col("last_mark"), "g_last", F.lit(0)).alias("opened"),
    )
    closed = placed.where("seps > 0")
    crossing = closed.select("file", F.col("first").alias("ordinal"), (F.col("start") + F.col("head") - F.col("opened")).alias("n_tokens"))
    inner = closed.select("file", "first", F.posexplode_outer("inner").alias("i", "n_tokens")).where("i is not null")
    inner = inner.select("file", (F.col("first") + 1 + F.col("i")).alias("ordinal"), "n_tokens")
    ends = placed.groupBy("file").agg(
        F.max(F.col("first") + F.col("seps")).alias("ordinal"),
        (F.max(F.col("start") + F.col("size")) - F.max(F.when(F.col("seps") > 0, F.col("start") + F.col("size") - F.col("tail")).otherwise(F.lit(0)))).alias("n_tokens"),
    ).where("n_tokens > 0")
    done = crossing.unionByName(inner).withColumn("open", F.lit(False))
    return done.unionByName(ends.withColumn("open", F.lit(True)))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: documents tokenised to flat files, which are then counted."""
    held = flat_files(docs, id_col=id_col, text_col=text_col, **how)
    found = lengths(held.where("bytes is not null"), how.get("end_id", END_ID), how.get("width", WIDTH))
    listed = held.where("bytes is null").select("file", "ordinal", "doc_id")
    return listed.join(found.where("not open"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
