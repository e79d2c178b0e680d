"""Tables, written intermediates, Arrow text batches and word hashes shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import checkpoint_root, swept

#: Bytes of text that one numpy step looks at; longer documents are looked at alone.
SLICE_BYTES = 1 << 19

U64 = np.uint64
_POLY = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, lost executors re-read files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    swept(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *wishes: str) -> list[str]:
    """Column names like the wishes that df has not (names do not differ by case alone)."""
    taken, out = {c.lower() for c in df.columns}, []
    for wish in wishes:
        while wish.lower() in taken:
            wish += "_"
        taken.add(wish.lower())
        out.append(wish)
    return out


def tasks(spark: SparkSession) -> int:
    """How many pieces to cut a shuffled intermediate into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def by_key(df: DataFrame, key: str, extra: list, fn, schema: str, per: int = 1) -> DataFrame:
    """Arrow batches of the rows of whole keys: rows are dealt by key and sorted by key and extra;
    fn gets a partition's iterator of batches in that order."""
    spread = df.repartition(tasks(df.sparkSession) * per, F.col(key))
    return spread.sortWithinPartitions(key, *extra).mapInArrow(fn, schema)


# ---- Arrow text ----------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


def lower_ascii(b: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D in documents that lie end to end:
    (starts, ends, first word of each document and the count of all)."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_space(b)
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True  # a document ends where the next begins
    after = np.append(inside[1:], False)
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers): every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word of its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = b[starts[0] :]
    at = starts - starts[0]
    inside = np.arange(len(body)) - np.repeat(at, np.diff(np.append(at, len(body))))
    power = powers(_POLY, int((ends - starts).max()))
    worth = np.where(is_space(body), U64(0), power[np.minimum(inside, len(power) - 1)])
    with np.errstate(over="ignore"):
        total = np.add.reduceat((body.astype(np.uint64) + U64(1)) * worth, at)
    return mixed(total ^ (ends - starts).astype(np.uint64))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    power = powers(0xD6E8FEB86659FD93, k + 1)[1:]
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * power[j]
    return mixed(out)


# ---- number arrays in binary columns ---------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes: high bytes lie together, so that shuffle compression sees them."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unpack(data, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)
