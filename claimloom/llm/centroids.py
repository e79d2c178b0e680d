"""Centroid clustering: rounds of exact nearest centroids, found by a threshold algorithm over sorted lists.

For every dimension the centroids stand in a list sorted by their component.  A vector's walk begins at its
own component in every list and goes outward, each step to the nearer of the two next entries; a centroid met
for the first time gets its exact distance.  No centroid that is still unmet can be nearer than the sum of the
squared gaps at the frontiers of all lists, so a walk stops when that sum strictly exceeds the best distance
(at equality an unmet centroid could tie with a smaller number), or when every centroid has been met.  The
walks of a slice of vectors are taken together in numpy, all in whole numbers.

A round assigns the vectors in tasks, which add up components and counts per cluster before anything is
shuffled; the driver gets k x dims sums and sends k x dims centroids (the only broadcast; neither grows with
the rows).  Sums and floors are exact, so no result depends on partitions.  Kept vectors are written once, in
whole numbers, to the shared folder, and each round reads them there.

Defined cases: only vectors of exactly `dims` components, none null or not finite, are kept, other rows take
no part and are not returned; components become floor(scale * x), and where that is over 2**26 in size a
ValueError names the bound, as squares could leave 64 bits; a null id is assigned like others but never starts
a centroid; rows that repeat an id are vectors of their own, of which the smaller starts a centroid; with fewer
than k vectors each starts one; ties go to the smaller number; a centroid without vectors stays where it is; an
empty table gives an empty result; columns other than id and vector are ignored by `digests` and kept by
`clustered`, which replaces columns of the names of its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.shared import free, scratch, written

K, DIMS, ROUNDS, SEED, SCALE = 40, 64, 5, 2, 256
#: The largest whole component: squares of differences of 64 of them, added up, stay in 64 bits.
LARGEST = 1 << 26
#: Beyond every component, so that the end of a list is never the nearer side while the other has entries.
_END = 1 << 29
#: Vectors whose walks one numpy step takes together.
_SLICE = 512


class Lists:
    """Centroids with their sorted list per dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dims = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable").T
        ends = np.full((dims, 1), _END, np.int64)
        # an entry for each end of a list; the centroids named there are never looked at
        self.values = np.hstack([-ends, np.take_along_axis(centroids.T, order, 1), ends])
        self.names = np.hstack([order[:, :1], order, order[:, -1:]])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, squared distance, distances computed) of the nearest centroid of each vector."""
        who, far, met = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), _SLICE):
            part = slice(i, i + _SLICE)
            who[part], far[part], met[part] = self._walks(x[part])
        return who, far, met

    def _walks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        dim = np.arange(dims)
        right = np.stack([np.searchsorted(self.values[d, 1:-1], x[:, d]) + 1 for d in range(dims)], 1)
        left = right - 1
        found = np.full((len(x), k), np.iinfo(np.int64).max)
        met = np.zeros((len(x), k), bool)
        open_ = np.arange(len(x))
        low, high = x - self.values[dim, left], self.values[dim, right] - x  # gaps at the two frontiers
        while len(open_):
            down = low <= high
            new = np.zeros((len(open_), k), bool)
            new[np.arange(len(open_))[:, None], self.names[dim, np.where(down, left, right)]] = True
            # a list that has ended on both sides has shown every centroid
            new &= ~met[open_]
            met[open_] |= new
            row, name = np.nonzero(new)
            found[open_[row], name] = ((x[open_[row]] - self.centroids[name]) ** 2).sum(1)
            left, right = np.maximum(left - down, 0), np.minimum(right + ~down, k + 1)
            own = x[open_]
            low, high = own - self.values[dim, left], self.values[dim, right] - own
            frontier = (np.minimum(np.minimum(low, high), 2 * LARGEST) ** 2).sum(1)  # no gap inside a list is larger
            go = ~met[open_].all(1) & (frontier <= found[open_].min(1))
            open_, left, right, low, high = open_[go], left[go], right[go], low[go], high[go]
        who = found.argmin(1)
        return who, found[np.arange(len(x)), who], met.sum(1)


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """Whether a vector has only finite components; false for a null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def kept(vectors: DataFrame, vec_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """The rows that take part."""
    return vectors.where(finite(F.col(vec_col)) & (F.size(vec_col) == dims))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of `dims` whole numbers as rows."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    if len(out) and max(int(out.max()), -int(out.min())) > LARGEST:
        raise ValueError(f"a component is over {LARGEST} in size once scaled")
    return out


def _started(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.where(F.col("id").isNotNull()).orderBy(order, "whole").limit(k).collect()  # k of them
    return np.array([r["whole"] for r in first], np.int64).reshape(-1, dims)


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total, n): a row per task and component of a cluster that got vectors."""
    k, dims = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(shared.value)
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("whole"), dims)
            who, _, _ = lists.nearest(x)
            np.add.at(total, who, x)
            n += np.bincount(who, minlength=k)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, dims), np.tile(np.arange(dims), len(some)), total[some].reshape(-1), np.repeat(n[some], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "dim", "total", "n"])

    return rows.select("whole").mapInArrow(add, "cluster long, dim long, total long, n long")


def fit(rows: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of rows (id, whole) after some rounds."""
    centroids = _started(rows, k, seed, dims)
    for _ in range(rounds if len(centroids) else 0):
        sums = _sums(rows, centroids).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # k x dims rows at most
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, whole_col: str = "whole", out: tuple[str, str] = ("cluster", "distance")) -> DataFrame:
    """rows with the number of the nearest centroid and the squared distance, without the whole numbers."""
    keep = [c for c in rows.columns if c != whole_col]
    schema = rows.select(*keep).schema.add(out[0], T.IntegerType()).add(out[1], T.LongType())
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(shared.value)
        for batch in batches:
            who, far, _ = lists.nearest(matrix(batch.column(whole_col), centroids.shape[1]))
            columns = [*[batch.column(c) for c in keep], pa.array(who, pa.int32()), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *out])

    return rows.mapInArrow(look, schema) if len(centroids) else rows.sparkSession.createDataFrame([], schema)


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS,
    seed: int = SEED, scale: int = SCALE, out: tuple[str, str] = ("cluster", "distance"),
) -> tuple[DataFrame, np.ndarray]:
    """(the kept rows of vectors with cluster and distance, the centroids)."""
    rows = kept(vectors, vec_col, dims)
    slim = written(rows.select(F.col(id_col).alias("id"), whole(F.col(vec_col), scale).alias("whole")), "whole")
    centroids = fit(slim, k, dims, rounds, seed)
    (name,) = free(vectors, "whole")
    left = [c for c in vectors.columns if c not in out]
    return assigned(rows.select(*left, whole(F.col(vec_col), scale).alias(name)), centroids, name, out), centroids


def digests(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 per kept row."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    found, centroids = clustered(slim, "vec_id", "embedding", **how)
    found = written(found.select("vec_id", "cluster", "distance"), "clusters")
    totals = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows at most
    rows = [
        (i, totals.get(i, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
