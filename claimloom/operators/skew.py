"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 200_000
# At most this many hot keys are broadcast; the row threshold rises until they fit.
MAX_HOT_KEYS = 500_000


def spread(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Rows over at least as many tasks as there are cores, when the files give fewer splits
    (one small file, one big row group); a large scan is left as it is.  With most_rows, rows that take long each are
    dealt to so many tasks that none gets many more."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if most_rows is not None:
        tasks = max(tasks, -(-df.count() // most_rows))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n), counted map-side before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(key, fanout) for keys above hot_rows, or None when there are none.

    The few hot keys are checkpointed, so counting happens once and plans stay flat.
    """
    hot = cut_lineage(counts.where(F.col("n") > hot_rows).select(key, "n"))
    if hot.isEmpty():
        return None
    while not fits_broadcast(hot.where(F.col("n") > hot_rows), MAX_HOT_KEYS):
        hot_rows *= 10
    return hot.where(F.col("n") > hot_rows).select(
        key, F.ceil(F.col("n") / hot_rows).cast("int").alias("fanout")
    )


def salted_join(
    many: DataFrame,
    other: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join where `many` may hold hot keys: their rows are spread over `fanout` salts by the hash
    of `spread_by`, and the matching rows of `other` are copied once per salt.  Every pair of
    rows still meets exactly once.  `counts` (key, n) saves the counting pass when the caller
    already knows the key sizes."""
    hot = hot_keys(key_counts(many, key) if counts is None else counts, key, hot_rows)
    if hot is None:
        return many.join(other, key, how)
    hot = F.broadcast(hot)
    left = (
        many.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("fanout").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("fanout"))
            ).otherwise(F.lit(0)).cast("int"),
        )
        .drop("fanout")
    )
    right = (
        other.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("fanout"), F.lit(1)) - 1)))
        .drop("fanout")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
