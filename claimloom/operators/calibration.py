"""How well confidence tells the truth: isotonic fit and reliability per verdict.

The isotonic fit pools adjacent violators.  Pooling may be done piecewise, as blocks pooled within a range of
scores pool further with those of the next, and so the work is an associative merge: scores are counted map-side,
ranges are pooled in tasks, and what is left, at most a block per distinct score, is pooled once more.  Scores are
rounded to `DIGITS` decimals, which bounds that by a million blocks whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


class Blocks:
    """Pooled blocks in order of score: [positives, rows, least score, greatest score]."""

    def __init__(self) -> None:
        self.held: list[list] = []

    def add(self, positives: int, rows: int, low: float, high: float) -> None:
        held = self.held
        held.append([positives, rows, low, high])
        # whole numbers are compared, so that equal rates pool whatever the order
        while len(held) > 1 and held[-2][0] * held[-1][1] >= held[-1][0] * held[-2][1]:
            p, n, _, high = held.pop()
            held[-1][0] += p
            held[-1][1] += n
            held[-1][3] = high


_BLOCK = "positives long, n long, low double, high double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = Blocks()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("positives", "n", "low", "high"))):
            blocks.add(*row)
    if blocks.held:
        columns = [pa.array(c, t) for c, t in zip(zip(*blocks.held), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["positives", "n", "low", "high"])


def isotonic(predictions: DataFrame) -> DataFrame:
    """(low, high, n, rate) of the steps of the best non-decreasing fit to predictions(score, label 0/1); rows
    without either are left out."""
    counted = predictions.where("score IS NOT NULL AND label IS NOT NULL").groupBy(F.round("score", DIGITS).alias("low")).agg(
        F.sum(F.col("label").cast("long")).alias("positives"), F.count(F.lit(1)).alias("n")
    )
    rows = counted.select("positives", "n", "low", F.col("low").alias("high"))
    parts = rows.repartitionByRange("low").sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)
    # a block per distinct score at most, so one task takes what is left
    whole = parts.repartition(1).sortWithinPartitions("low").mapInArrow(_pooled, _BLOCK)
    return whole.select("low", "high", "n", (F.col("positives") / F.col("n")).alias("rate"))


def calibrated(predictions: DataFrame, steps: DataFrame) -> DataFrame:
    """predictions with `rate`, that of the last step that begins at or below the score (the first step's below all)."""
    table = steps.agg(F.sort_array(F.collect_list(F.struct("low", "rate")))).scalar()  # a million steps at most
    held = predictions.withColumn("_steps", table)
    below = F.filter("_steps", lambda s: s["low"] <= F.round("score", DIGITS))
    rate = F.when(F.col("score").isNotNull(), F.coalesce(F.get(below, F.size(below) - 1)["rate"], F.get("_steps", F.lit(0))["rate"]))
    return held.withColumn("rate", rate).drop("_steps")


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Per verdict and bin of predictions(verdict, score, label): rows, mean score, share of positives and their gap."""
    bin_ = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    rows = predictions.where("score IS NOT NULL AND label IS NOT NULL").withColumn("bin", bin_)
    exact = F.sum(F.round("score", DIGITS).cast("decimal(20,6)")).cast("double")
    return rows.groupBy("verdict", "bin").agg(
        F.count(F.lit(1)).alias("n"), (exact / F.count(F.lit(1))).alias("mean_score"), (F.sum("label") / F.count(F.lit(1))).alias("rate")
    ).withColumn("gap", F.col("rate") - F.col("mean_score"))
