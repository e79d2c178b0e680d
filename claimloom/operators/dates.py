"""Time windows: an overlap join in bins of several widths, and the penalties that dates draw.

A window is a pair of dates (first and last day).  Two windows that overlap share a bin of the wider of their
two widths, and are paired in the later of their first bins there, once.  A window is cut into bins of the least
width of which it covers at most `PER_WINDOW`, so a window of decades is a few wide bins and not thousands of days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.skew import salted_join

#: Bin widths in days, each so many times the one before.
STEP = 16
LEVELS = 5
PER_WINDOW = 16


def _day(at: Column) -> Column:
    return F.unix_date(at.cast("date"))


def _binned(windows: DataFrame, keep: list[str]) -> DataFrame:
    """A row per level from a window's own on and bin there: level, bin, own (its level), first (its first bin there)."""
    low, high = _day(F.col("first_day")), _day(F.col("last_day"))
    level = reduce(
        lambda wider, n: F.when(F.floor(high / STEP**n) - F.floor(low / STEP**n) < PER_WINDOW, n).otherwise(wider),
        range(LEVELS - 1, -1, -1), F.lit(LEVELS),
    )
    fine = windows.where(F.col("first_day").isNotNull() & F.col("last_day").isNotNull() & (low <= high))
    rows = fine.select(*keep, low.alias("low"), high.alias("high"), level.alias("own"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(LEVELS))))
    width = F.pow(F.lit(float(STEP)), F.col("level"))
    first = F.floor(F.col("low") / width)
    return rows.withColumn("first", first).withColumn("bin", F.explode(F.sequence(first, F.floor(F.col("high") / width))))


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, days): pairs of left(left_id, first_day, last_day) and right(right_id, first_day, last_day)
    that share a day, and how many they share.  Windows without both days, or that end before they begin, pair with nothing."""
    key = F.concat_ws(":", "level", "bin")
    a = _binned(left, [left_id]).select(key.alias("_bin"), "level", "bin", left_id, *[F.col(c).alias(f"_l_{c}") for c in ("low", "high", "own", "first")])
    b = _binned(right, [right_id]).select(key.alias("_bin"), right_id, *[F.col(c).alias(f"_r_{c}") for c in ("low", "high", "own", "first")])
    met = salted_join(b, a, "_bin", [right_id])
    days = F.least("_l_high", "_r_high") - F.greatest("_l_low", "_r_low") + 1
    here = (F.col("level") == F.greatest("_l_own", "_r_own")) & (F.col("bin") == F.greatest("_l_first", "_r_first"))
    return met.where(here & (days > 0)).select(left_id, right_id, days.cast("int").alias("days"))


def date_penalties(claimed: DataFrame, established: DataFrame, slack_days: int = 1, longer: float = 2.0) -> DataFrame:
    """(claim_id, penalty_type) from claimed(claim_id, first_day, last_day), the event as a claim dates it, and
    established(claim_id, first_day, last_day), a row per piece of evidence that dates it.

    DATE_MISMATCH where evidence dates the event and none of it comes within `slack_days` of the claimed window;
    EXAGGERATION where all of it lies inside the claimed window, which is more than `longer` times as long as all
    of it together.  Claims or evidence without both days say nothing; rows of one claim may be any number, as
    only their least and greatest days and one flag are kept."""
    c = claimed.where(F.col("first_day") <= F.col("last_day")).select(
        "claim_id", _day(F.col("first_day")).alias("c_low"), _day(F.col("last_day")).alias("c_high")
    )
    e = established.where(F.col("first_day") <= F.col("last_day")).select(
        "claim_id", _day(F.col("first_day")).alias("low"), _day(F.col("last_day")).alias("high")
    )
    near = (F.col("low") <= F.col("c_high") + slack_days) & (F.col("high") >= F.col("c_low") - slack_days)
    # the claim's own days are constant within it, so the evidence is reduced before anything is gathered
    facts = salted_join(e, c, "claim_id", ["low", "high"]).groupBy("claim_id", "c_low", "c_high").agg(
        F.max(near).alias("met"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    inside = (F.col("low") >= F.col("c_low")) & (F.col("high") <= F.col("c_high"))
    much = (F.col("c_high") - F.col("c_low") + 1) > longer * (F.col("high") - F.col("low") + 1)
    kind = F.when(~F.col("met"), "DATE_MISMATCH").when(inside & much, "EXAGGERATION")
    return facts.select("claim_id", kind.alias("penalty_type")).where(F.col("penalty_type").isNotNull())
