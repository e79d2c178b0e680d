"""Landed files: feeds, media, JSON submissions; and the Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import media as M
from claimloom.functions import text as X

_RSS = (
    "title string, link string, description string, pubDate string, updated string, "
    "`content:encoded` string"
)
_ATOM = (
    "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, "
    "published string, updated string"
)


def _feed_time(raw):
    text = X.strip(raw)
    no_day = F.regexp_replace(text, r"^[A-Za-z]{3,},\s*", "")
    zone = F.regexp_replace(no_day, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(text),
    )


def read_feeds(spark: SparkSession, path: str, feeds: DataFrame, kind: str = "rss", entries_per_feed: int | None = V.ENTRIES_PER_FEED) -> DataFrame:
    """Entries of landed RSS ('item' rows) or Atom ('entry' rows) files.

    A file is matched to its feed by name: ``<domain>.xml``.  The first entries_per_feed entries of a file
    are read, all of them with None; an entry without link or title is skipped.
    """
    tag, schema = ("item", _RSS) if kind == "rss" else ("entry", _ATOM)
    raw = (
        spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        .withColumn("_file", F.input_file_name())
        .withColumn("_n", F.monotonically_increasing_id())
    )
    if kind == "rss":
        link, body, extra = F.col("link"), F.col("description"), F.col("`content:encoded`")
        published = F.coalesce(_feed_time(F.col("pubDate")), _feed_time(F.col("updated")))
    else:
        link = F.get(F.col("link"), F.lit(0))["_href"]
        body, extra = F.col("summary"), F.col("content")
        published = F.coalesce(_feed_time(F.col("published")), _feed_time(F.col("updated")))
    order = Window.partitionBy("_file").orderBy("_n")
    summary = X.strip_markup(F.coalesce(body, F.lit("")))
    entries = (
        raw.withColumn("entry_no", F.row_number().over(order))
        .where(F.lit(True) if entries_per_feed is None else F.col("entry_no") <= entries_per_feed)
        .select(
            F.regexp_extract("_file", r"([^/]+)\.xml$", 1).alias("domain"),
            "entry_no",
            X.strip(link).alias("url"),
            X.strip_markup(F.col("title")).alias("title"),
            F.when(summary != "", summary).otherwise(X.strip_markup(F.coalesce(extra, F.lit("")))).alias("text"),
            published.alias("published_at"),
        )
        .where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    )
    dim = feeds.select("domain", F.col("name").alias("source_name"), "source_type", "language")
    return entries.join(dim, "domain").withColumn("provider", F.lit("RSS_CORPUS"))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, path, content, byte_size, modified_at) of files below a folder."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("media_id"),
            "path", "content", F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"),
        )
    )


def media_layout(files: DataFrame, day: str) -> DataFrame:
    """Add the date-partitioned storage key of files(media_id, content) landed on `day`."""
    mime = M.detect_type(F.col("content"))
    return files.withColumn("storage_key", M.storage_key(F.col("media_id"), F.lit(day).cast("date"), mime))


def write_run(result: dict[str, DataFrame], path: str, run_date: str) -> None:
    """Write the tables of one run below `path`, partitioned by run date (and language where a table has
    one).  A run that is written again replaces the partitions it wrote."""
    for name, df in result.items():
        parts = ["run_date"] + (["language"] if "language" in df.columns else [])
        rows = df.withColumn("run_date", F.lit(run_date))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")
