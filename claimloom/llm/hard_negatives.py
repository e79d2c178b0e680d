"""Hard-negative mining: for each anchor and positive, the best rows of other labels in a band of scores.

Scores are inner products of whole vectors.  Few pairs get theirs computed:

* Codes.  Vectors are rotated (signs and Hadamard steps, in whole numbers, so that every machine gets the same)
  and kept as one sign bit a component with their alignment, the mean size of the components, which is the best
  factor for the signs; what is left over is coded again, `CODES` times, and the length of the last rest is kept.
* Estimates.  An anchor's rotated vector is rounded to six bit planes; its product with a code is then a sum
  of population counts, off by no more than the sum of its rounding errors.
* Intervals.  The rest adds at most the product of lengths (Cauchy-Schwarz), where the part of the anchor along
  the last code counts for nothing, as the rest is at right angles to it.  So each score lies in a known interval;
  only rows whose interval reaches the scores still wanted are scored in whole numbers.  No row is lost.

Two passes: the first finds the positives (best rows of the anchor's label), the second the negatives.  In each,
anchors are dealt in blocks of about `BLOCK`, rows in groups; a task holds one block of anchors and streams a
group of rows past it, keeping the best few per anchor (per positive in the second), which also raises what later
rows must reach.  The few kept by each group are then ranked per anchor.  Nothing passes through the driver but
counts.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite, take no part;
vectors meet only vectors of their own length (an empty one scores 0); rows that repeat an id are rows of their
own, an anchor's positives are other rows; ties go to the smaller id; an anchor without positives, and a positive
without negatives in its band, gives no row; components whose products could leave 64 bits raise a ValueError; an
empty table gives an empty result; columns other than id, label and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.llm import shared as S
from claimloom.llm.centroids import finite, whole

POSITIVES, NEGATIVES = 5, 3
#: Hundredths of the positive's score between which a negative's score lies.
BAND = (50, 95)
SCALE = 256
CODES = 4
#: Anchors that a task holds at once.
BLOCK = 4096
#: Groups of rows for each shuffle task.
GROUPS = 2
_PLANES = 6
#: Pairs whose intervals one numpy step takes.
_PAIRS = 1 << 16
_NONE = np.iinfo(np.int64).min


# ---- codes ---------------------------------------------------------------------------


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by two rounds of fixed signs and Hadamard steps; lengths grow by the padded size."""
    size = max(64, 1 << max(x.shape[1] - 1, 0).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for turn in range(2):
        signs = S.mixed(np.arange(size, dtype=np.uint64) + np.uint64(turn * size + 1)) & np.uint64(1)
        out *= np.where(signs == 1, -1.0, 1.0)
        width = 1
        while width < size:
            pairs = out.reshape(len(out), -1, 2, width)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), size)
            width *= 2
    return out


def bits(flags: np.ndarray) -> np.ndarray:
    """The last axis as 64-bit words."""
    return np.packbits(flags, axis=-1, bitorder="little").view("<u8")


def codes(x: np.ndarray, count: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(sign words of each code, alignments of the codes with the lengths of the last rest and of the whole)."""
    rest = rotated(x)
    length = np.sqrt((rest**2).sum(1))
    words, facts = [], []
    for _ in range(count):
        up = rest >= 0
        align = np.abs(rest).mean(1)
        rest = rest - np.where(up, align[:, None], -align[:, None])
        words.append(bits(up))
        facts.append(align)
    return np.stack(words, 1), np.stack([*facts, np.sqrt((rest**2).sum(1)), length], 1)


class Anchors:
    """Rotated anchors in bit planes."""

    def __init__(self, x: np.ndarray):
        turned = rotated(x)
        self.size = turned.shape[1]
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << _PLANES) - 1), 1e-300)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, (1 << _PLANES) - 1)
        self.off = np.abs(turned - (self.low[:, None] + self.step[:, None] * level)).sum(1)
        self.planes = np.stack([bits((level.astype(np.int64) >> b) & 1 == 1) for b in range(_PLANES)], 1)
        self.sum = level.sum(1)
        self.length = np.sqrt((turned**2).sum(1))

    def intervals(self, i: slice | np.ndarray, words: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of anchors i (rows) with coded vectors (columns)."""
        low, step, off, length = (a[i, None] for a in (self.low, self.step, self.off, self.length))
        middle = np.zeros((len(self.low[i]), len(words)))
        count = np.uint16 if self.size << _PLANES < 1 << 16 else np.int32
        for j in range(words.shape[1]):
            up = np.bitwise_count(words[:, j]).sum(-1, dtype=np.int64)
            held = np.zeros(middle.shape, count)
            for b in range(_PLANES):
                for w in range(words.shape[2]):
                    both = np.bitwise_count(self.planes[i, b, w][:, None] & words[None, :, j, w])
                    held += np.left_shift(both, b, dtype=count)
            product = low * (2 * up - self.size) + step * (2.0 * held - self.sum[i, None])
            middle += product * facts[:, j]
        along = np.maximum(np.abs(product) - off, 0) ** 2 / self.size  # by the last code
        across = np.sqrt(np.maximum(length**2 - along, 0))
        # the last term is far more than what sums of floating numbers may be off by
        wide = off * facts[:, : words.shape[1]].sum(1) + across * facts[:, -2] + 1e-9 * length * facts[:, -1]
        scale = float(self.size) ** 2
        return (middle - wide) / scale, (middle + wide) / scale


# ---- keeping the best ------------------------------------------------------------------


class Best:
    """The best `k` (score, id, row) of each of n places, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = (np.full((n, k), _NONE) for _ in range(3))

    def floor(self) -> np.ndarray:
        """The score that a newcomer must reach."""
        return self.score[:, -1]

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        some = np.unique(place)
        if not len(some):
            return
        held = self.score[some] != _NONE
        own = np.broadcast_to(some[:, None], held.shape)[held]
        columns = [np.concatenate(c) for c in zip((place, score, ids, rows), (own, self.score[some][held], self.id[some][held], self.row[some][held]))]
        order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
        place, score, ids, rows = (c[order] for c in columns)
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        first = rank < self.k
        for held, new in zip((self.score, self.id, self.row), (score, ids, rows)):
            held[some] = _NONE
            held[place[first], rank[first]] = new[first]

    def rows(self) -> tuple[np.ndarray, ...]:
        place, rank = np.nonzero(self.score != _NONE)
        return place, self.score[place, rank], self.id[place, rank], self.row[place, rank]


def scores(a: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole inner products of pairs."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("nd,nd->n", a[i[part]], x[j[part]])
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k]


class Rows:
    """A batch of rows, sorted by label."""

    def __init__(self, columns: dict):
        order = np.argsort(columns["label"], kind="stable")
        self.label, self.id, self.row = (columns[c][order] for c in ("label", "id", "row"))
        self.x = columns["whole"][order]
        self.words = columns["words"][order]
        self.facts = columns["facts"][order]


class Positives:
    """Best rows of the anchors' own labels, of one block."""

    def __init__(self, anchors: Rows, k: int):
        self.own, self.made, self.best = anchors, Anchors(anchors.x), Best(len(anchors.row), k)
        self.scored = self.seen = 0

    def meet(self, rows: Rows) -> None:
        own, k = self.own, self.best.k
        for label in np.unique(own.label):
            a, z = np.searchsorted(own.label, [label, label + 1])
            b, y = np.searchsorted(rows.label, [label, label + 1])
            step = max(1, _PAIRS // max(y - b, 1))
            for i in range(a, z if y > b else a, step):
                part = slice(i, min(i + step, z))
                low, high = self.made.intervals(part, rows.words[b:y], rows.facts[b:y])
                other = own.row[part][:, None] != rows.row[None, b:y]
                least = _kth(np.where(other, low, -np.inf), k)
                held = self.best.floor()[part]
                least = np.maximum(least, np.where(held == _NONE, -np.inf, held.astype(float)))
                p, j = np.nonzero(other & (high >= least[:, None]))
                p, j = p + part.start, j + b
                self.seen, self.scored = self.seen + other.size, self.scored + len(p)
                self.best.add(p, scores(own.x, p, rows.x, j), rows.id[j], rows.row[j])

    def found(self) -> dict:
        place, score, ids, rows = self.best.rows()
        return {"anchor_row": self.own.row[place], "anchor_id": self.own.id[place], "score": score, "id": ids, "row": rows}


class Negatives:
    """Best rows of other labels within the bands of the anchors' positives, of one block."""

    def __init__(self, anchors: Rows, slots: tuple[np.ndarray, ...], k: int, band: tuple[int, int]):
        self.own, self.made = anchors, Anchors(anchors.x)
        # a slot per positive, sorted by anchor: (anchor's place, row, id, score)
        self.at, self.slot_row, self.slot_id, self.slot_score = slots
        # a score s is in the band of a positive p when band[0] * p <= 100 * s <= band[1] * p
        self.low, self.high = -((-band[0] * self.slot_score) // 100), band[1] * self.slot_score // 100
        self.best = Best(len(self.at), k)
        self.first = np.searchsorted(self.at, np.arange(len(anchors.row) + 1))
        self.open = np.unique(self.at[self.low <= self.high])
        self.scored = self.seen = 0

    def _over(self, fn: np.ufunc, values: np.ndarray, none: float) -> np.ndarray:
        """fn over the slots of each anchor whose bands hold a number."""
        out = np.full(len(self.own.row), none)
        some = self.low <= self.high
        fn.at(out, self.at[some], values[some].astype(float))
        return out

    def meet(self, rows: Rows) -> None:
        own, k = self.own, self.best.k
        if not len(self.open):
            return
        floor = self.best.floor()
        reach = np.maximum(self.low, floor)
        least, most = self._over(np.minimum, reach, np.inf), self._over(np.maximum, self.high, -np.inf)
        sure_low, sure_high = self._over(np.maximum, self.low, -np.inf), self._over(np.minimum, self.high, np.inf)
        step = max(1, _PAIRS // max(len(rows.row), 1))
        for at in range(0, len(self.open), step):
            part = self.open[at : at + step]
            low, high = self.made.intervals(part, rows.words, rows.facts)
            other = own.label[part][:, None] != rows.label[None, :]
            # rows in every band for sure: below the k-th of them nothing is wanted
            sure = other & (low >= sure_low[part, None]) & (high <= sure_high[part, None])
            reached = np.maximum(least[part], _kth(np.where(sure, low, -np.inf), k))
            p, j = np.nonzero(other & (high >= reached[:, None]) & (low <= most[part, None]))
            p = part[p]
            self.seen, self.scored = self.seen + other.size, self.scored + len(p)
            score = scores(own.x, p, rows.x, j)
            many = self.first[p + 1] - self.first[p]
            pair = np.repeat(np.arange(len(p)), many)
            slot = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + self.first[p][pair]
            fits = (score[pair] >= self.low[slot]) & (score[pair] <= self.high[slot])
            pair, slot = pair[fits], slot[fits]
            self.best.add(slot, score[pair], rows.id[j[pair]], rows.row[j[pair]])

    def found(self) -> dict:
        place, score, ids, rows = self.best.rows()
        at = self.at[place]
        return {
            "anchor_row": self.own.row[at], "anchor_id": self.own.id[at],
            "positive_row": self.slot_row[place], "positive_id": self.slot_id[place], "positive_score": self.slot_score[place],
            "score": score, "id": ids, "row": rows,
        }


# ---- jobs ------------------------------------------------------------------------------

_CODED = "row long, id long, label long, dims int, deal double, whole binary, words binary, facts binary"
_SLOTS = "array<struct<row:long,id:long,score:long>>"


def coded(rows: DataFrame, count: int = CODES) -> DataFrame:
    """Rows (row, id, label, dims, deal, whole) with codes and facts, numbers as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            lists, n = batch.column("whole"), len(dims)
            out: list[list] = [[b""] * n for _ in range(3)]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), d)
                largest = int(np.abs(x).max(initial=0)) if d else 0
                if largest > 1 << 26 or largest**2 * d >= 1 << 62:
                    raise ValueError("products of these components could leave 64 bits")
                words, facts = codes(x, count)
                for k, i in enumerate(at.tolist()):
                    for held, own in zip(out, (x[k], words[k], facts[k])):
                        held[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "label", "dims", "deal")), *(pa.array(o, pa.binary()) for o in out)],
                ["row", "id", "label", "dims", "deal", "whole", "words", "facts"],
            )

    return rows.mapInArrow(encode, _CODED)


def _raw(column: pa.Array, dtype, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(shape)


def _rows(batch: pa.RecordBatch, dims: int, count: int) -> Rows:
    n = batch.num_rows
    size = max(64, 1 << max(dims - 1, 0).bit_length())
    return Rows(
        {
            "row": batch.column("row").to_numpy(), "id": batch.column("id").to_numpy(), "label": batch.column("label").to_numpy(),
            "whole": _raw(batch.column("whole"), "<i8", (n, dims)), "words": _raw(batch.column("words"), "<u8", (n, count, size // 64)),
            "facts": _raw(batch.column("facts"), "<f8", (n, count + 2)),
        }
    )


def _searched(anchors: DataFrame, rows: DataFrame, many: int, count: int, make, fields: list[str]) -> DataFrame:
    """What `make` keeps of each group of rows, for each block of anchors."""
    spark = rows.sparkSession
    blocks = max(1, -(-many // BLOCK))
    groups = max(1, -(-S.tasks(spark) * GROUPS // blocks))
    parts = blocks * groups
    names = ["dims", "row", "id", "label", "whole", "words", "facts", "slots"]
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    held = anchors.withColumn("block", F.floor(F.col("deal") * blocks).cast("int")).withColumn("group", F.explode(every))
    passing = rows.withColumn("group", F.floor(F.col("deal") * groups).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    passing = passing.withColumn("slots", F.lit(None).cast(_SLOTS))
    both = held.select((F.col("block") * groups + F.col("group")).alias("part"), F.lit(0).alias("kind"), *names).unionByName(
        passing.select((F.col("block") * groups + F.col("group")).alias("part"), F.lit(1).alias("kind"), *names)
    )
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "dims", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, met = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if met is not None:
                found = met.found()
                yield pa.RecordBatch.from_arrays([pa.array(found[f], pa.int64()) for f in fields], fields)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "dims", "kind")], 1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)] if len(keys) else []):
                part, dims, kind = keys[a].tolist()
                if (part, dims) != at:
                    yield from done()
                    at, waiting, met = (part, dims), [], None
                piece = batch.slice(a, z - a)
                if kind == 0:
                    waiting.append(piece)
                elif waiting or met is not None:
                    if met is None:
                        whole_ = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        met, waiting = make(whole_, dims), []
                    met.meet(_rows(piece, dims, count))
        yield from done()

    return dealt.mapInArrow(search, ", ".join(f"{f} long" for f in fields))


def mined(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label", anchor: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE, count: int = CODES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Anchors are the rows for which
    `anchor` (a condition on the id, by default every row's) holds; label is a whole number."""
    label = F.col(label) if isinstance(label, str) else label
    anchor = F.lit(True) if anchor is None else anchor
    some = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & finite(F.col(vec_col)))
    plain = some.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.size(vec_col).alias("dims"),
        F.rand(1).alias("deal"),
        whole(F.col(vec_col), scale).alias("whole"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    plain = S.written(plain, "vectors")
    rows = S.written(coded(plain.drop("asks"), count), "coded")
    asking = plain.where("asks").select(F.col("row").alias("asking"))
    anchors = S.written(rows.join(asking, F.col("row") == F.col("asking"), "left_semi"), "anchors")
    many = anchors.count()

    def own(batch: pa.RecordBatch, dims: int) -> Positives:
        return Positives(_rows(batch, dims, count), positives)

    fields = ["anchor_row", "anchor_id", "row", "id", "score"]
    near = _searched(anchors.withColumn("slots", F.lit(None).cast(_SLOTS)), rows, many, count, own, fields)
    first = W.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    best = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    slots = best.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "id", "score")).alias("slots"))  # `positives` of them
    asked = S.written(anchors.join(slots, F.col("row") == F.col("anchor_row")).drop("anchor_row"), "positives")

    def others(batch: pa.RecordBatch, dims: int) -> Negatives:
        lists = batch.column("slots").to_pylist()
        held = _rows(batch, dims, count)
        place = {row: i for i, row in enumerate(held.row.tolist())}
        flat = sorted((place[row], s["row"], s["id"], s["score"]) for row, own in zip(batch.column("row").to_pylist(), lists) for s in own)
        return Negatives(held, tuple(np.array(c, np.int64) for c in zip(*flat)), negatives, band)

    fields = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "id", "score"]
    far = _searched(asked, rows, many, count, others, fields)
    order = W.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "id", "row")
    found = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
