"""N-gram Jaccard join: exact links between documents whose shingle sets have Jaccard >= a ratio.

1 - Jaccard is a metric, and the join works in regions of that space.

* Documents with equal sets are one point; the one with the smallest id stands for it.
* First regions.  Whole documents as pivots of the whole corpus would not part it: nearly all
  distances are 1, so every boundary window would hold everything.  The first cells are therefore
  those of a partition of all shingles into m classes.  Two sets at most D apart (in elements that
  only one of them has) agree on at least m - D classes, so with m > D they share a cell (class,
  content of the class).  Sizes are cut into intervals of one ratio: a set goes to the cells of its own
  interval and of the next, which is the window for pairs over the interval's end.  Cells are made of
  the shingles that are not common (at most `COMMON` of those that recur within batches, broadcast), so that
  a passage which very many documents share does not chain them together; sets with little else have
  cells of all their shingles too.  Any choice of common shingles gives the same links.  Documents that
  share cells form a region (connected components over distinct links to a cell's smallest id).
* A region of more than `loose` shingles (by default one too large for a task) is parted again, as passages of
  middling frequency may have chained it: of each document the shingles that fewest documents of the region hold, as many as it can lack in a
  partner and one more, are its cells (two linked sets share one of these, in whatever order shingles are
  ranked).  A document with that many shingles of its own has no partner.
* Within a region, pivots make Voronoi cells by true distances; a document is copied to every other
  cell whose pivot is at most twice the threshold farther than its own (triangle inequality), and
  cells are joined recursively until they are small or no longer shrink, then pair by pair.  Pairs
  known to be in one component are not compared.
* A region too large for one task is compared in blocks of pivots against all its documents, in
  rounds, until each document outside its largest component has been a pivot.

Defined cases: null or blank texts have empty sets and no links; texts of fewer words than a shingle
are one shingle; very long texts are read whole; rows that repeat an id are one node and come back one by one; rows with a null id
come back with a null component and no links; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.llm import shared as S
from claimloom.llm.graph import components, dealt_anew
from claimloom.session import cut_lineage

#: Shingles of a region that one task takes; larger regions are compared in blocks.
REGION_SHINGLES = 6_000_000
#: Pivots of a block.
BLOCK = 512
#: Shingles that count as common, and in how many documents of a batch one has to occur.
COMMON = 100_000
COMMON_LEAST, COMMON_SHARE = 4, 2000
#: Documents of a cell that are compared pair by pair, and pivots of a larger one.
LEAF = 64
PIVOTS = 8
_CLASS_SEED = np.uint64(0x5851F42D4C957F2D)


# ---- sets ------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of `words` words in a row of each document, ASCII lower-cased."""
    low = S.lower_ascii(data)
    starts, ends, first = S.words(low, offsets)
    hashes = S.word_hashes(low, starts, ends)
    runs = S.run_hashes(hashes, words)
    out = []
    for at, end in zip(first[:-1].tolist(), first[1:].tolist()):
        n = end - at
        if n >= words:
            out.append(np.unique(runs[at : end - words + 1]))
        elif n:
            out.append(S.run_hashes(hashes[at:end], n) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    for i, j in S.slices(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


# ---- cells -----------------------------------------------------------------------------


@cache
def _intervals(num: int, den: int, size: int) -> tuple[int, int, int]:
    """(index, low, high) of the interval of sizes that holds a size; high / low is at most den / num."""
    index, low = 0, 1
    while True:
        high = max(low, low * den // num)
        if size <= high:
            return index, low, high
        index, low = index + 1, high + 1


@cache
def _classes(num: int, den: int, high: int, low: int) -> tuple[int, int]:
    """(D, m): the most elements that two linked sets of at most `high` each differ by, and classes.

    Over D + 1 there are as many more as classes are likely to be empty, so that agreeing on empty
    classes alone is rare (`cells` says what happens then).
    """
    apart = 2 * high * (den - num) // (den + num)
    if not apart:
        return 0, 0
    empty = (apart + 1) * np.exp(-low / (apart + 1))
    return apart, apart + 1 + int(np.ceil(empty + 4 * np.sqrt(empty)))


def cells(sets: list[np.ndarray], num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set of each key): two sets with Jaccard >= num / den and different contents share a key.

    They agree on at least m - D classes, also when only the shingles that are not in `common` (sorted) are
    looked at.  A set with fewer empty classes than that agrees with every partner on one that is not
    empty.  A set with as many or more gives keys of all its shingles as well; if even then it has as many
    empty classes, those of empty classes too.  Two such sets meet there.
    """
    jobs = []
    for i, s in enumerate(sets):
        if not len(s):
            continue
        index, low, high = _intervals(num, den, len(s))
        jobs.append((i, index, low, high))
        _, next_low, next_high = _intervals(num, den, high + 1)
        if len(s) * den // num >= next_low:
            jobs.append((i, index + 1, next_low, next_high))
    plan = [(i, index, *_classes(num, den, high, low)) for i, index, low, high in jobs]
    plan = [p for p in plan if p[3]]
    if not plan:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.array([len(sets[i]) for i, *_ in plan])
    m = np.array([p[3] for p in plan])
    least = m - np.array([p[2] for p in plan])
    base = np.concatenate([[0], np.cumsum(m)])
    h = np.concatenate([sets[i] for i, *_ in plan])
    with np.errstate(over="ignore"):
        kind = (S.mixed(h ^ _CLASS_SEED) >> np.uint64(32)) * np.repeat(m.astype(np.uint64), size) >> np.uint64(32)
        group = kind.astype(np.int64) + np.repeat(base[:-1], size)
        worth = S.mixed(h * np.uint64(0xDA942042E4DD58B5))
    owner = np.repeat(np.arange(len(plan)), m)
    place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
    tag = (np.array([p[1] for p in plan]).astype(np.uint64)[owner] << np.uint64(40)) + place + np.uint64(1)

    def contents(use: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of each class, whether it has elements, empty classes of each set)."""
        at = group[use]
        order = np.argsort(at, kind="stable")
        at = at[order]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        sums, full = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
        with np.errstate(over="ignore"):
            if len(at):
                sums[at[new]] = np.add.reduceat(worth[use][order], new)
                full[at[new]] = True
            keys = S.mixed(sums + S.mixed(tag + (np.uint64(mode) << np.uint64(62))))
        return keys, full, m - np.add.reduceat(full.astype(np.int64), base[:-1])

    rare = np.ones(len(h), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
    keys, given, empty = contents(rare, 0)
    poor = empty >= least
    of = np.array([p[0] for p in plan])[owner]
    out, sources = [keys[given]], [of[given]]
    if poor.any():
        keys, full, empty = contents(np.repeat(poor, size), 1)
        given = poor[owner] & (full | (empty >= least)[owner])
        out.append(keys[given])
        sources.append(of[given])
    return np.concatenate(out), np.concatenate(sources)


def common_shingles(texts: DataFrame, words: int, most: int = COMMON) -> np.ndarray:
    """Sorted hashes of shingles that recur in many documents of the same batches: at most `most`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_bytes(batch.column(0))
            found = list(_sets(data, offsets, words))
            every, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            often = n >= max(COMMON_LEAST, len(found) // COMMON_SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(every[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

    counts = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(top["shingle"].to_numpy().astype(np.int64).view(np.uint64))


#: 56 bits of a key travel; a chance match only puts unrelated documents into one region.
_KEY_BITS = np.uint64((1 << 56) - 1)
_FRAGMENT = "bucket int, kind int, keys binary, docs binary, more binary"
_MET = "kind int, a long, b long, n long"


def _fragments(docs: DataFrame, words: int, num: int, den: int, buckets: int, common) -> DataFrame:
    """Of each batch of documents, by bucket: sets (kind 0), cells (1) and links found in the batch (2)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all = batch.column(0).to_numpy()
            data, offsets = S.text_bytes(batch.column(1))
            for i, j in S.slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                ids = ids_all[i:j]
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                    two = np.array([S.mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                one, two = S.mixed(one + n.astype(np.uint64)), S.mixed(two)
                # of equal sets in the slice, the smallest id alone looks for cells
                order = np.lexsort((ids, two, one))
                fresh = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
                lead = order[fresh]
                keys, of = cells([sets[x] for x in lead], num, den, common.value)
                keys &= _KEY_BITS
                owner = ids[lead][of]
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
                first = owner[new][np.cumsum(new) - 1] if len(keys) else owner
                links = np.unique(np.stack([owner, first], 1)[owner != first], axis=0)
                yield from _dealt(0, one, ids, buckets, np.stack([two.view(np.int64), n], 1))
                yield from _dealt(1, keys[new], owner[new], buckets)
                yield from _dealt(2, links[:, 0].astype(np.uint64), links[:, 1], buckets)

    return docs.mapInArrow(scan, _FRAGMENT)


def _dealt(kind: int, keys: np.ndarray, docs: np.ndarray, buckets: int, more: np.ndarray | None = None):
    if not len(keys):
        return
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        part = order[at[b] : at[b + 1]]
        if len(part):
            extra = b"" if more is None else S.pack(more[part].reshape(-1))
            rows.append((b, kind, S.pack(keys[part]), S.pack(docs[part]), extra))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), *[pa.binary()] * 3])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "keys", "docs", "more"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: (0, id, smallest id of the equal sets, size) per row, (1, id, smallest id of a shared cell)."""

    def out(kind: int, a, b, n) -> pa.RecordBatch:
        kinds = np.full(len(a), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, a, b, n)], ["kind", "a", "b", "n"])

    def met(rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if rows.get(0):
            one, ids = (np.concatenate([r[x] for r in rows[0]]) for x in (0, 1))
            more = np.concatenate([r[2] for r in rows[0]]).reshape(-1, 2)
            order = np.lexsort((ids, more[:, 0], one))
            one, ids, two, n = one[order], ids[order], more[order, 0], more[order, 1]
            new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
            yield out(0, ids, np.where(n > 0, ids[new][np.cumsum(new) - 1], ids), n)
        links = []
        if rows.get(1):
            keys, ids = (np.concatenate([r[x] for r in rows[1]]) for x in (0, 1))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.append(True, keys[1:] != keys[:-1])
            first = ids[new][np.cumsum(new) - 1]
            links.append(np.stack([ids, first], 1)[ids != first])
        for keys, ids, _ in rows.get(2, []):
            links.append(np.stack([keys.astype(np.int64), ids], 1))
        if links:
            both = np.unique(np.concatenate(links), axis=0)
            if len(both):
                yield out(1, both[:, 0].copy(), both[:, 1].copy(), np.zeros(len(both), np.int64))

    bucket, rows = None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                yield from met(rows)
                bucket, rows = r["bucket"], {}
            more = S.unpack(r["more"], np.int64) if r["more"] else None
            rows.setdefault(r["kind"], []).append((S.unpack(r["keys"], np.uint64), S.unpack(r["docs"], np.int64), more))
    yield from met(rows)


# ---- joining a region ------------------------------------------------------------------


class Region:
    """Documents of one region and the links found so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.num, self.den = ids, num, den
        self.n = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.tokens = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, int)
        self.mark = np.zeros(self.tokens.max() + 1 if len(self.tokens) else 0, bool)
        self.of = np.arange(len(ids))  # component of each
        self.links: list[tuple[int, int]] = []

    def shared(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot's set with those of rows."""
        own = self.tokens[self.at[pivot] : self.at[pivot + 1]]
        self.mark[own] = True
        size = self.n[rows]
        place = np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out = np.add.reduceat(self.mark[self.tokens[place]].astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        self.mark[own] = False
        return out

    def distances(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        both = self.shared(pivot, rows)
        return 1 - both / (self.n[rows] + self.n[pivot] - both)

    def link(self, pivot: int, rows: np.ndarray) -> None:
        """Link the pivot with those of rows that are near it and not yet in its component."""
        low, high = self.n[pivot] * self.num, self.n[pivot] * self.den
        rows = rows[(self.n[rows] * self.den >= low) & (self.n[rows] * self.num <= high)]
        rows = rows[self.of[rows] != self.of[pivot]]
        if len(rows):
            both = self.shared(pivot, rows)
            rows = rows[both * self.den >= self.num * (self.n[rows] + self.n[pivot] - both)]
        if len(rows):
            self.links += [(self.ids[pivot], self.ids[r]) for r in rows.tolist()]
            self.of[np.isin(self.of, self.of[rows])] = self.of[pivot]

    def join(self, rows: np.ndarray) -> None:
        """Every link among rows, but those within a component."""
        if len(rows) > LEAF:
            reach = 2 * (self.den - self.num) / self.den + 1e-9
            # the first pivot is the first row, each next one the row farthest from those before
            near, pivots = self.distances(int(rows[0]), rows)[None], [0]
            while len(pivots) < PIVOTS and near.min(0).max() > 0:
                pivots.append(int(near.min(0).argmax()))
                near = np.append(near, self.distances(int(rows[pivots[-1]]), rows)[None], 0)
            parts = [rows[near[p] - near.min(0) <= reach] for p in range(len(pivots))]
            if max(map(len, parts)) <= 0.9 * len(rows) and sum(map(len, parts)) <= 2 * len(rows):
                for part in parts:
                    self.join(part)
                return
        for i, pivot in enumerate(rows.tolist()):
            self.link(pivot, rows[i + 1 :])


def _compare(words: int, num: int, den: int):
    """Links of each (region, block): among all its documents, or between its pivots and the others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, pivots = None, [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            region = Region(ids, sets, num, den)
            if pivots:
                for p in range(pivots):
                    region.link(p, np.arange(p + 1, len(ids)))
            elif len(ids) > 1:
                region.join(np.arange(len(ids)))
            if region.links:
                a, b = zip(*region.links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            data, offsets = S.text_bytes(batch.column("text"))
            made = _sets(data, offsets, words)
            for region, block, role, doc, own in zip(*(batch.column(c).to_pylist() for c in ("region", "block", "role", "doc")), made):
                if (region, block) != group:
                    yield from found()
                    group, ids, sets, pivots = (region, block), [], [], 0
                if len(own):
                    ids.append(doc)
                    sets.append(own)
                    pivots += role == 0
        yield from found()

    return compare


def _by_region(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among members (region, block, role, doc)."""
    rows = texts.join(members, texts["doc_id"] == members["doc"]).select("region", "block", "role", "doc", "text")
    # a group is a bounded number of shingles; several share a task
    dealt = rows.repartition(S.tasks(rows.sparkSession) * 2, "region", "block").sortWithinPartitions("region", "block", "role", "doc")
    return dealt.mapInArrow(_compare(words, num, den), "a long, b long")


def _shingles_of(words: int):
    """(doc, shingle) rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_bytes(batch.column("text"))
            ids = batch.column("doc").to_numpy()
            for i, j in S.slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                docs = np.repeat(ids[i:j], [len(s) for s in sets])
                if len(docs):
                    every = np.concatenate(sets).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(every)], ["doc", "shingle"])

    return spread


def _parted_again(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """members (region, doc, n) of large regions in regions of rarest shingles; those without any are left out."""
    # an id of several texts is one node: all that its texts share with others are its cells
    nodes = cut_lineage(members.groupBy("region", "doc").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts")))
    rows = texts.join(nodes, texts["doc_id"] == nodes["doc"]).select("doc", "text")
    spread = rows.mapInArrow(_shingles_of(words), "doc long, shingle long")
    tokens = S.written(spread.join(nodes.select("doc", "region"), "doc"), "shingles")
    often = dealt_anew(tokens.groupBy("region", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle")
    shared = S.written(tokens.join(often, ["region", "shingle"]), "shared")
    # a linked partner lacks at most n - ceil(num n / den) of n shingles; one's own are lacked by all
    held = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("shared")).join(nodes, "doc")
    needs = F.col("shared") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    needs = held.select("doc", F.when(F.col("texts") > 1, F.col("shared")).otherwise(needs).alias("needs")).where("needs > 0")
    rank = F.row_number().over(W.partitionBy("doc").orderBy("df", "shingle"))  # of one document's shingles
    keys = S.written(shared.join(needs, "doc").withColumn("rank", rank).where("rank <= needs").select("region", "shingle", "doc"), "rarest")
    first = dealt_anew(keys.groupBy("region", "shingle").agg(F.min("doc").alias("first")), "shingle")
    edges = keys.join(first, ["region", "shingle"]).select(F.col("doc").alias("a"), F.col("first").alias("b"))
    labels = components(edges)
    return members.select("doc", "n").join(labels, F.col("doc") == labels["node"]).select(F.col("component").alias("region"), "doc", "n")


def _sized(members: DataFrame) -> DataFrame:
    """members with the shingles and documents of their regions, where there are two documents or more."""
    sizes = members.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    return cut_lineage(members.join(dealt_anew(sizes, "region"), "region"))


def links(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
          region_shingles: int = REGION_SHINGLES, block: int = BLOCK, loose: int = REGION_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): (doc, rep, n) per row with an id, rep the smallest id with the same set; edges
    (a, b) between documents that are linked, enough of them to connect every component."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = S.tasks(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, words))
    parts = _fragments(texts, words, num, den, buckets, common).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = S.written(parts.mapInArrow(_meet, _MET), "cells")
    rows = met.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("rep"), "n")
    copies = rows.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    candidates = met.where("kind = 1").select("a", "b").unionByName(copies)
    labels = components(candidates)
    members = rows.where("doc = rep and n > 0").distinct().join(labels, F.col("doc") == labels["node"]).select(
        F.col("component").alias("region"), "doc", "n"
    )
    members = cut_lineage(members)
    sized = _sized(members)
    chained = F.col("total") > min(loose, region_shingles)
    if not sized.where(chained).isEmpty():
        again = _sized(_parted_again(sized.where(chained).select("region", "doc", "n"), texts, words, num, den))
        sized = sized.where(~chained).unionByName(again)
    small = sized.where(F.col("total") <= region_shingles).select("region", F.lit(0).alias("block"), F.lit(1).alias("role"), "doc")
    edges = cut_lineage(_by_region(small, texts, words, num, den))
    large = sized.where(F.col("total") > region_shingles).select(
        "region", "doc", F.pmod(F.xxhash64("doc"), F.ceil(F.col("total") / region_shingles)).cast("int").alias("block")
    )
    retired = large.select("doc").limit(0)
    while not large.isEmpty():
        label = components(edges)
        owned = cut_lineage(
            large.join(label, large["doc"] == label["node"], "left").select("region", "block", "doc", F.coalesce("component", "doc").alias("of"))
        )
        share = owned.groupBy("region", "of").agg(F.count(F.lit(1)).alias("docs"))
        main = share.groupBy("region").agg(F.max(F.struct("docs", "of")).alias("top"))
        main = cut_lineage(main.select("region", F.col("top.of").alias("main")))
        left = owned.join(main, "region").where("of <> main").join(retired, "doc", "left_anti")
        order = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("doc"), "doc"))
        pivots = cut_lineage(left.withColumn("turn", order).where(F.col("turn") <= block).select("region", "doc"))
        if pivots.isEmpty():
            break
        blocks = large.select("region", "block").distinct()
        asked = pivots.join(blocks, "region").select("region", "block", F.lit(0).alias("role"), "doc")
        rest = large.join(pivots.select("doc"), "doc", "left_anti").join(pivots.select("region").distinct(), "region", "left_semi")
        more = _by_region(asked.unionByName(rest.select("region", "block", F.lit(1).alias("role"), "doc")), texts, words, num, den)
        edges = cut_lineage(edges.unionByName(more))
        retired = cut_lineage(retired.unionByName(pivots.select("doc")))
    return rows, edges.unionByName(copies)


def linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id."""
    rows, edges = links(docs, words, num, den, id_col, text_col, **how)
    label = components(edges)
    out = rows.join(label, F.col("doc") == label["node"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")).mapInArrow(_sizes(words), "n_shingles long")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_bytes(batch.column(0))
            n = [len(s) for s in _sets(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_shingles"])

    return count


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that have a linked document of smaller id in their component; all columns."""
    found = linked(docs, words, num, den, id_col, text_col, **how)
    # a written table has a known size, so that few ids are broadcast and the texts stay where they are
    (name,) = S.free(docs, "gone")
    gone = S.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
