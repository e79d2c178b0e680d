"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents become token ids and an end token; only those longer than a sequence are cut.  Pieces are
sorted by size over ranges, which gives each a rank among those of its size.  A round then

1. lets every size, from the largest down, look for its successor among the gaps of open sequences
   (the smallest gap that holds it), then for the next one, until its pieces are matched;
2. settles conflicts by rank: the first pieces of a size meet the first gaps of a width, by an
   equality join on (match, place);
3. updates the gaps, and the next round begins.

A gap takes as many pieces of one size as fit, which is what best fit does with equal sizes one after
another.  Pieces over half a sequence open one each at the start; a size that no gap can hold opens
sequences of its own.  Only counts per size and per gap (at most one row per token of a sequence
each) pass through the driver; pieces and gaps meet in distributed joins, and each round is cut off
by a checkpoint.

Ids are those of the tokenizer file: the string of an added token in a text is that token's id.

Defined cases: a null text has the end token alone; rows that repeat an id are documents of their
own; a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import tasks, written
from claimloom.llm.tokens import default_files, encode_default
from claimloom.session import cut_lineage

CAPACITY = 1024
END_ID = 2

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, end_id: int, files: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """A row per piece of every document."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode_default(text.as_py() or "", files), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length])))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _PIECE.split(", ")])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tokenise, _PIECE)


def _ranked(items: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """items with rank, a place from 0 among those of their size; how many there are of each size."""
    spark = items.sparkSession
    ranged = items.repartitionByRange(tasks(spark), "size", "doc_id", "piece").sortWithinPartitions("size", "doc_id", "piece")
    at = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()))
    # ranges overlap in at most one size each: tasks + sizes rows at most
    runs = at.groupBy("size", F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    total: dict[int, int] = {}
    shift = []
    for run in sorted(runs, key=lambda r: (r["size"], r["task"])):
        before = total.get(run["size"], 0)
        shift.append((run["size"], run["task"], before - run["low"]))
        total[run["size"]] = before + run["n"]
    shifts = spark.createDataFrame(shift, "size long, task long, shift long")
    ranks = at.withColumn("task", F.shiftright("at", 33)).join(F.broadcast(shifts), ["size", "task"])
    return cut_lineage(ranks.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "task", "shift")), total


def successor_sweep(wanted: dict[int, tuple[int, int]], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of one round: (size, first piece rank, pieces, gap, first gap rank, pieces a gap).

    wanted: (next rank, end) by size; gaps: how many by width.  No gap is used twice in a round.
    """
    widths, used, out = sorted(gaps), dict.fromkeys(gaps, 0), []
    for size in sorted(wanted, reverse=True):
        at, end = wanted[size]
        for width in widths[int(np.searchsorted(widths, size)) :]:
            if at == end:
                break
            free = gaps[width] - used[width]
            if free:
                each = width // size
                n = min(end - at, free * each)
                out.append((size, at, n, width, used[width], each))
                used[width] += -(-n // each)
                at += n
    return out


def openings(left: dict[int, tuple[int, int]], fresh: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(size, first rank, end) of the pieces that open sequences: all over half a sequence, else the
    largest until as many sequences are open as the tokens of the sizes that no gap holds need."""
    need = -(-sum(s * (left[s][1] - left[s][0]) for s in fresh) // capacity)
    out = []
    for size in sorted(fresh, reverse=True):
        at, end = left[size]
        each = capacity // size
        if each > 1:
            if need <= 0:
                break
            end = min(end, at + need * each)
        need -= -(-(end - at) // each)
        out.append((size, at, end))
    return out


def rounds(total: dict[int, int], capacity: int) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """The rounds over pieces counted by size: ("open", openings, []) or ("match", matches, moves).

    openings: (size, low, high, pieces each, first sequence, full ones, their gap and first rank, gap
    and rank of one that is not full).  matches: (match, size, low, n, gap, first gap rank, pieces
    each).  moves: (gap, low, high, new gap, shift): these gap ranks get a new width and rank.
    """
    wanted, gaps, sequences = {size: (0, n) for size, n in total.items()}, {}, 0
    while left := {s: w for s, w in wanted.items() if w[0] < w[1]}:
        over = [s for s in left if s > capacity // 2]
        widest = max(gaps, default=0)
        fresh = over or [s for s in left if s > widest]
        at_rank: dict[int, int] = dict(gaps) if fresh else {}
        if fresh:
            opens = []
            for size, at, end in openings(left, fresh, capacity):
                each = capacity // size
                whole, rest = divmod(end - at, each)
                full, last = capacity - each * size, capacity - rest * size
                full_low = at_rank.get(full, 0)
                at_rank[full] = full_low + whole
                last_low = at_rank.get(last, 0)
                at_rank[last] = last_low + bool(rest)
                opens.append((size, at, end, each, sequences, whole, full, full_low, last, last_low))
                sequences, wanted[size] = sequences + whole + bool(rest), (end, wanted[size][1])
            yield "open", opens, []
        else:
            matches, moves, used = successor_sweep(left, gaps), [], dict.fromkeys(gaps, 0)

            def move(gap: int, low: int, high: int, to: int) -> None:
                if low < high:
                    moves.append((gap, low, high, to, at_rank.get(to, 0) - low))  # noqa: B023
                    at_rank[to] = at_rank.get(to, 0) + high - low  # noqa: B023

            for size, at, n, gap, low, each in matches:
                whole, rest = divmod(n, each)
                move(gap, low, low + whole, gap - each * size)
                move(gap, low + whole, low + whole + bool(rest), gap - rest * size)
                used[gap] = low + whole + bool(rest)
                wanted[size] = (at + n, wanted[size][1])
            for gap, n in gaps.items():
                move(gap, used[gap], n, gap)
            yield "match", [(i, *m) for i, m in enumerate(matches)], moves
        gaps = {g: n for g, n in at_rank.items() if g and n}


def _longs(names: str) -> str:
    return ", ".join(f"{c} long" for c in names.split())


def _opened(ranked: DataFrame, opens: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(pieces in their new sequences, gaps of these)."""
    plan = ranked.sparkSession.createDataFrame(
        opens, _longs("size low high each base whole full full_low last last_low")
    )
    hit = (ranked["size"] == plan["size"]) & (ranked["rank"] >= plan.low) & (ranked["rank"] < plan.high)
    step, turn = F.floor((F.col("rank") - F.col("low")) / F.col("each")), (F.col("rank") - F.col("low")) % F.col("each")
    put = ranked.join(F.broadcast(plan), hit).drop(plan["size"]).withColumn("sequence_id", F.col("base") + step)
    is_full = step < F.col("whole")
    gaps = put.where(turn == 0).select(
        "sequence_id",
        F.when(is_full, F.col("full")).otherwise(F.col("last")).alias("gap"),
        F.when(is_full, F.col("full_low") + step).otherwise(F.col("last_low")).alias("rank"),
    )
    names = [c for c in ranked.columns if c != "rank"]
    return put.withColumn("offset", turn * F.col("size")).select(*names, "sequence_id", "offset"), gaps.where("gap > 0")


def _matched(ranked: DataFrame, gaps: DataFrame, matches: list[tuple], capacity: int) -> DataFrame:
    """Pieces in the gaps that they meet."""
    plan = ranked.sparkSession.createDataFrame(matches, _longs("match size low n gap gap_low each"))
    hit = (ranked["size"] == plan["size"]) & (ranked["rank"] >= plan.low) & (ranked["rank"] < plan.low + plan.n)
    step = F.col("rank") - F.col("low")
    names = [c for c in ranked.columns if c != "rank"]
    pieces_in = ranked.join(F.broadcast(plan), hit).drop(plan["size"]).select(
        *names, "match", F.floor(step / F.col("each")).alias("place"), (step % F.col("each")).alias("turn")
    )
    hit = (gaps["gap"] == plan["gap"]) & (gaps["rank"] >= plan.gap_low) & (gaps["rank"] < plan.gap_low + F.ceil(plan.n / plan.each))
    gaps_in = gaps.join(F.broadcast(plan), hit).drop(plan["gap"]).select(
        "sequence_id", "gap", "match", (F.col("rank") - F.col("gap_low")).alias("place")
    )
    put = pieces_in.join(gaps_in, ["match", "place"])
    offset = F.lit(capacity) - F.col("gap") + F.col("turn") * F.col("size")
    return put.withColumn("offset", offset).select(*names, "sequence_id", "offset")


def _moved(gaps: DataFrame, moves: list[tuple]) -> DataFrame:
    """The gaps of the next round."""
    plan = gaps.sparkSession.createDataFrame(moves, _longs("gap low high to shift")).where("to > 0")
    hit = (gaps["gap"] == plan["gap"]) & (gaps["rank"] >= plan.low) & (gaps["rank"] < plan.high)
    return gaps.join(F.broadcast(plan), hit).select(
        "sequence_id", F.col("to").alias("gap"), (F.col("rank") + F.col("shift")).alias("rank")
    )


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (doc_id, piece, size, ...) with sequence_id and offset."""
    ranked, total = _ranked(items)
    gaps, out = None, None
    for kind, plan, moves in rounds(total, capacity):
        if kind == "open":
            put, more = _opened(ranked, plan)
            gaps = cut_lineage(more if gaps is None else gaps.unionByName(more))
        else:
            put = cut_lineage(_matched(ranked, gaps, plan, capacity))
            gaps = cut_lineage(_moved(gaps, moves))
        out = put if out is None else out.unionByName(put)
    if out is None:
        out = ranked.drop("rank").withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset")})
    return out


def packed(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    files: tuple[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = written(pieces(docs, capacity, end_id, files or default_files(), id_col, text_col), "pieces")
    out = pack(cuts.withColumn("size", F.col("length")), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
