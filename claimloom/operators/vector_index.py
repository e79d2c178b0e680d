"""Exact nearest vectors from coarse cells with radii.

Vectors are kept by unit length, so that the larger cosine is the smaller distance.  Centroids come from
k-means over a bounded sample (`SAMPLE` rows by hash of the id); every row is then stored in the cell of its
nearest centroid with its distance to it, so the sample decides how fast a search is, never what it finds.

    centroids/          cell, centre
    vectors/add=a/cell=c/   vec_id, embedding, away
    cells/add=a/        cell, n, least, most: how near and how far the rows of a cell are

By the triangle inequality no row of a cell is nearer to a query than |distance to the centre - the row's own|,
over the cell than the query's distance less the farthest row's.  A search goes over a query's cells in order of that bound,
a few more in each round, until the next bound exceeds the k-th distance found; inside a cell the same bound
passes over rows.  Queries and rows meet in tasks that hold at most `BLOCK` of a cell's queries and stream
at most `PART` or so of its rows; nothing of either passes through the driver.

Null vectors, vectors of other lengths than the index has, vectors of zeros and those with null or not finite components are in no cell
and find nothing; a null id is stored like others and sorts last; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

SAMPLE = 20_000
#: Cells for each square root of the rows, and the most of them; the centres go to every task.
MOST_CELLS = 1024
BLOCK = 2048
PART = 16_384
#: Rounding of similarities, as in the plain search, and what a bound is loosened by for it.
DIGITS = 9
_LOOSE = 4e-9


def unit(embedding: np.ndarray) -> np.ndarray:
    return embedding / np.sqrt((embedding * embedding).sum(1))[:, None]


def _usable(df: DataFrame, dims: int) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _plain(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"))


@dataclass(frozen=True)
class VectorIndex:
    """The index in a folder."""

    spark: SparkSession
    root: str

    # ---- writing --------------------------------------------------------------------

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, dims: int | None = None, seed: int = 1) -> "VectorIndex":
        """Fit centroids to a sample of vectors(vec_id, embedding) and store all of them."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = _plain(vectors, "vec_id")
        total = rows.count()
        chance = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
        some = cut_lineage(rows.where(chance < min(1.0, 1.25 * sample / max(total, 1) + 100 / max(total, 1))).limit(2 * sample))
        if dims is None:
            lengths = some.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).count()
            top = lengths.orderBy(F.desc("count"), "dims").first()
            dims = top["dims"] if top else 1
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        units = _usable(some, dims).select(F.transform("embedding", lambda x: x / length).alias("embedding"))
        units = units.select(array_to_vector("embedding").alias("features"))
        cells = cells or max(1, min(MOST_CELLS, int(total**0.5)))
        centres = [[1.0] + [0.0] * (dims - 1)]
        if not units.isEmpty():
            centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=8).fit(units).clusterCenters()]
        self.spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").write.parquet(f"{self.root}/centroids")
        self.add(rows, number=0)
        return self

    def _centres(self) -> np.ndarray:
        held = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["centre"] for r in held])

    def add(self, vectors: DataFrame, number: int) -> None:
        """Store more vectors in the cells there are, as addition `number`; one written before is replaced."""
        centres = self._centres()
        shared, dims = self.spark.sparkContext.broadcast(centres), centres.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle = shared.value
            for batch in batches:
                cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                x = unit(_matrix(batch.column("embedding"), dims))
                for at in range(0, len(x), 4096):
                    part = slice(at, at + 4096)
                    cell[part] = ((middle**2).sum(1)[None] - 2 * x[part] @ middle.T).argmin(1)
                    away[part] = np.sqrt(((x[part] - middle[cell[part]]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], ["vec_id", "embedding", "cell", "away"])

        held = _usable(_plain(vectors, "vec_id"), dims).mapInArrow(assign, "vec_id long, embedding array<double>, cell int, away double")
        # in ranges, so that a large cell is written by several tasks
        dealt = held.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors/add={number}")
        written = self.spark.read.schema(dealt.schema).parquet(f"{self.root}/vectors/add={number}")
        cells = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        cells.write.mode("overwrite").parquet(f"{self.root}/cells/add={number}")

    # ---- reading --------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        schema = "vec_id long, embedding array<double>, away double, add int, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/vectors").drop("add")

    def cells(self) -> DataFrame:
        """cell, n, least, most."""
        held = self.spark.read.schema("cell int, n long, least double, most double, add int").parquet(f"{self.root}/cells")
        return held.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def topk(self, queries: DataFrame, k: int = 10, trace: dict | None = None) -> DataFrame:
        """query_id, vec_id, similarity, rank: the k nearest rows by cosine for each of queries(query_id, embedding),
        exactly; ties go to the smaller id.  `trace`, if given, gets `pairs` (queries x rows), `scored` and `rounds`."""
        centres = self._centres()
        dims = centres.shape[1]
        facts = {r["cell"]: (r["n"], r["least"], r["most"]) for r in self.cells().collect()}  # MOST_CELLS at most
        n, least, most = (np.array([facts.get(c, (0, np.inf, -np.inf))[i] for c in range(len(centres))]) for i in range(3))
        shared = self.spark.sparkContext.broadcast((centres, n, least, most))
        scored = self.spark.sparkContext.accumulator(0)
        asked = _usable(_plain(queries.where(F.col("query_id").isNotNull()), "query_id"), dims)
        state = cut_lineage(asked.select("query_id", "embedding", F.lit(0).alias("upto"), F.lit(-2.0).alias("floor")))
        best = self.spark.createDataFrame([], "query_id long, vec_id long, similarity double")
        sizes = self.cells().select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        rounds = 0

        def next_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(query, cell, distance to the centre, how many cells are then done) of the cells of this round."""
            centres, n, least, most = shared.value
            for batch in batches:
                q = unit(_matrix(batch.column("embedding"), dims))
                floor, upto = batch.column("floor").to_numpy(), batch.column("upto").to_numpy()
                out: list[list] = [[], [], [], []]
                for i in range(len(q)):
                    far = np.sqrt(((centres - q[i]) ** 2).sum(1))
                    bound = np.maximum(np.maximum(far - most, least - far), 0.0)
                    order = np.lexsort((far, bound))
                    order = order[n[order] > 0]
                    # the squared distance of a similarity s is 2 - 2 s
                    reach = np.sqrt(max(2 - 2 * floor[i] + _LOOSE, 0.0)) + _LOOSE
                    open_ = int(np.searchsorted(bound[order], reach, "right"))
                    enough = int(np.searchsorted(np.cumsum(n[order]), k)) + 1  # cells that hold k rows
                    stop = min(open_, max(enough, 4 * upto[i]))
                    some = order[upto[i] : stop]
                    for held, own in zip(out, (np.full(len(some), i), some, far[some], np.full(len(some), stop))):
                        held.append(own)
                at, cell, far, stop = (np.concatenate(h) if h else np.zeros(0) for h in out)
                rows = batch.select(["query_id", "embedding", "floor"]).take(pa.array(at.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(cell.astype(np.int32)), pa.array(far.astype(float)), pa.array(stop.astype(np.int32))],
                    ["query_id", "embedding", "floor", "cell", "far", "stop"],
                )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, found = None, [], None

            def done() -> Iterator[pa.RecordBatch]:
                if found is not None:
                    yield from found.rows()

            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "part", "block", "kind")], 1)
                cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)] if len(keys) else []):
                    *own, kind = keys[a].tolist()
                    if own != key:
                        yield from done()
                        key, held, found = own, [], None
                    piece = batch.slice(a, z - a)
                    if kind == 0:
                        held.append(piece)
                    elif held or found is not None:
                        if found is None:
                            found, held = _Found(pa.Table.from_batches(held), dims, k), []
                        scored.add(found.meet(piece))
            yield from done()

        while True:
            asks = cut_lineage(state.mapInArrow(next_cells, "query_id long, embedding array<double>, floor double, cell int, far double, stop int"))
            if asks.isEmpty():
                break
            rounds += 1
            blocks = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(sizes, "cell")
            blocks = F.broadcast(cut_lineage(blocks))  # a row per cell
            numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
            # a query is in one of a cell's blocks, whichever part it goes to
            held = asks.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
            one = held.select(
                "cell", numbers("parts").alias("part"), "block", F.lit(0).alias("kind"), F.col("query_id").alias("id"), "embedding", "far", "floor"
            )
            two = self.vectors().join(blocks, "cell").select(
                "cell", F.floor(F.rand(1) * F.col("parts")).cast("int").alias("part"), numbers("blocks").alias("block"), F.lit(1).alias("kind"),
                F.col("vec_id").alias("id"), "embedding", F.col("away").alias("far"), F.lit(0.0).alias("floor"),
            )
            dealt = one.unionByName(two).repartition("cell", "part", "block").sortWithinPartitions("cell", "part", "block", "kind")
            new = dealt.mapInArrow(meet, "query_id long, vec_id long, similarity double")
            order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("vec_id").asc_nulls_last())
            best = cut_lineage(best.unionByName(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
            floors = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("new_floor"))
            stops = asks.groupBy("query_id").agg(F.max("stop").alias("stop"))
            # queries without a cell in this round are settled
            state = cut_lineage(
                state.join(stops, "query_id").join(floors, "query_id", "left").select(
                    "query_id", "embedding", F.col("stop").alias("upto"), F.coalesce("new_floor", F.lit(-2.0)).alias("floor")
                )
            )
        if trace is not None:
            trace.update(rounds=rounds, scored=scored.value, pairs=asked.count() * int(n.sum()))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("vec_id").asc_nulls_last())
        return best.withColumn("rank", F.row_number().over(order))


class _Found:
    """The best k rows met by each query of a block."""

    def __init__(self, queries: pa.Table, dims: int, k: int):
        queries = queries.combine_chunks().to_batches()[0]
        self.ids, self.k = queries.column("id").to_numpy(), k
        self.unit = unit(_matrix(queries.column("embedding"), dims))
        self.far, self.floor, self.dims = queries.column("far").to_numpy(), queries.column("floor").to_numpy().copy(), dims
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.ids]

    def meet(self, rows: pa.RecordBatch) -> int:
        """Take a batch of the cell's rows; how many pairs got a similarity."""
        v, away = _matrix(rows.column("embedding"), self.dims), rows.column("far").to_numpy()
        order = np.argsort(away)
        v, away = v[order], away[order]
        ids = rows.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()[order]
        norms, scored = np.sqrt((v * v).sum(1)), 0
        for i in range(len(self.ids)):
            reach = np.sqrt(max(2 - 2 * self.floor[i] + _LOOSE, 0.0)) + _LOOSE
            a, z = np.searchsorted(away, [self.far[i] - reach, self.far[i] + reach])
            if a == z:
                continue
            scored += int(z - a)
            # rounded, so that equal vectors tie whatever the order of a sum
            near = np.round(v[a:z] @ self.unit[i] / norms[a:z], DIGITS)
            fits = near >= self.floor[i]
            near, own = np.append(self.best[i][0], near[fits]), np.append(self.best[i][1], ids[a:z][fits])
            top = np.lexsort((own, -near))[: self.k]
            self.best[i] = near[top], own[top]
            if len(top) == self.k:
                self.floor[i] = max(self.floor[i], near[top[-1]])
        return scored

    def rows(self) -> Iterator[pa.RecordBatch]:
        many = [len(s) for s, _ in self.best]
        if sum(many):
            vec = np.concatenate([v for _, v in self.best])
            ids = pa.array(vec, mask=vec == np.iinfo(np.int64).max)
            similarity = np.concatenate([s for s, _ in self.best])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, many)), ids, pa.array(similarity)], ["query_id", "vec_id", "similarity"])
