"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes.  Distinct blocks are sorted, and
a block's place in that order is its integer name.  Adjacent names are then paired, distinct pairs
are sorted and named in the same way, and so on until one name is left per document.  Two
documents have the same (level, name) exactly when their normalised texts are equal.

Blocks are ordered by a 64-bit digest first and by content where digests tie, so contents are
compared (one shuffle of the distinct blocks, merged map-side) but only digests travel on.
A digest that stands for several contents is told apart by content (`_told_apart`).

Texts of one block (nearly all of common corpora at this block size) have their identity at the first
level; only longer ones are named in pairs.

Defined cases: very long texts are cut into blocks and compared whole; a null text counts as empty, and empty texts are equal; a null id sorts last; rows
that repeat an id are rows of their own, and of equal (id, text) rows one stays; an empty table
gives an empty result; other columns are ignored by `identities` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.functions.text import bind, unnest
from claimloom.llm.graph import dealt_anew
from claimloom.llm.shared import free, tasks, written
from claimloom.session import cut_lineage

BLOCK_BYTES = 16384
_WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; runs that are one space already don't match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " ")


def _blocks(text: Column, size: int) -> Column:
    def cut(data: Column) -> Column:
        last = F.greatest(F.ceil(F.length(data) / size).cast("int") - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size))
        )

    return bind(text.cast("binary"), cut)


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `name`, the place of their keys among all distinct keys in sorted order."""
    distinct = rows.select(*keys).distinct()
    order = distinct.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    names = cut_lineage(order.withColumn("name", F.monotonically_increasing_id()))
    return rows.join(names, keys).drop(*keys)


def _told_apart(blocks: DataFrame, ids: DataFrame, collided: DataFrame) -> DataFrame:
    """(id, sha, pos, sub) of the blocks whose digest stands for several contents."""
    some = blocks.join(collided, "h", "left_semi")
    rank = W.partitionBy("h").orderBy("block")
    subs = some.select("h", "block").distinct().withColumn("sub", F.row_number().over(rank))
    return ids.join(subs, ["h", "block"]).select("id", "sha", "pos", "sub").distinct()


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column], Column] = lambda block: F.xxhash64(block),
) -> DataFrame:
    """A row per row of docs: (row, id, sha, level, name); equal (level, name), equal texts."""
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    hashed = written(
        base.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.transform(_blocks(F.col("norm"), block_bytes), digest).alias("digests"),
        ),
        "blocks",
    )
    at = unnest(hashed, ["row", "id", "sha", F.size("digests").alias("n")], F.col("digests"), "h", "pos")

    def contents() -> DataFrame:
        return unnest(base, [], _blocks(F.col("norm"), block_bytes), "block").select(digest(F.col("block")).alias("h"), "block")

    distinct = contents().groupBy("h", "block").agg(F.count(F.lit(1)).alias("copies"))
    collided = cut_lineage(
        distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h")
    )
    if collided.isEmpty():
        at = at.withColumn("sub", F.lit(0))
    else:
        spelled = unnest(
            base.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)),
            ["id", "sha"],
            _blocks(F.col("norm"), block_bytes),
            "block",
            "pos",
        ).withColumn("h", digest(F.col("block")))
        subs = _told_apart(contents(), spelled, collided).withColumnsRenamed({"id": "__id", "sha": "__sha", "pos": "__pos"})
        same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")) & (F.col("pos") == F.col("__pos"))
        at = at.join(subs, same, "left").drop("__id", "__sha", "__pos").withColumn("sub", F.coalesce("sub", F.lit(0)))
    level = 0
    names = cut_lineage(_named(at.drop("id", "sha"), ["h", "sub"]))
    longest = names.agg(F.max("n")).first()[0] or 0
    done = [names.where("n = 1").select("row", F.lit(level).alias("level"), "name")]
    while longest > 1:
        left = names.where("n > 1")
        pairs = left.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names, longest, level = cut_lineage(_named(pairs, ["a", "b"])), (longest + 1) // 2, level + 1
        done.append(names.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return hashed.select("row", "id", "sha").join(every, "row")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per row of docs: (row, id, sha, keep_id, group_size, kept)."""
    named = cut_lineage(identities(docs, id_col, text_col, **how))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = named.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    # both sides of the join below are dealt anew, so that a hot name is split
    groups = dealt_anew(groups, "name")
    return named.join(groups, ["level", "name"]).select(
        "row", "id", "sha", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each set of equal texts, the one with the smallest id."""
    found = cut_lineage(copies(docs, id_col, text_col, **how))
    key, own_id, own_sha = free(docs, "key", "kept_id", "kept_sha")
    kept = found.where("kept").select(F.col("id").alias(own_id), F.col("sha").alias(own_sha))
    keyed = docs.withColumn(key, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    stay = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_sha)), "left_semi")
    twins = found.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if not twins.isEmpty():
        stay = stay.dropDuplicates([id_col, key])
    return stay.select(*docs.columns)
