"""Feed and primary-source registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import vocab as V


def feeds(raw: DataFrame) -> DataFrame:
    """raw(feed_no, name, url, domain, language, country, category, source_type, enabled) with
    defaults filled; an entry without name, URL or domain, or of unknown type, is skipped."""
    required = F.col("name").isNotNull() & F.col("url").isNotNull() & F.col("domain").isNotNull()
    return (
        raw.where(required)
        .fillna(
            {
                "language": "en", "country": "", "category": "general", "source_type": "UNKNOWN",
                "enabled": True,
            }
        )
        .where(F.col("source_type").isin(*V.SOURCE_TYPES))
    )


def primary_sources(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    """(category, domain, name, source_type); a name defaults to its domain."""
    rows = V.PRIMARY_SOURCES if entries is None else entries
    df = spark.createDataFrame(rows, "category string, domain string, name string, source_type string")
    return (
        df.where(F.col("domain").isNotNull())
        .withColumn("name", F.coalesce("name", "domain"))
        .withColumn("source_type", F.coalesce("source_type", F.lit("UNKNOWN")))
        .where(F.col("source_type").isin(*V.SOURCE_TYPES))
    )


def load_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feeds, primary sources) from one JSON document {"feeds": [...], "primary_sources":
    {category: [...]}}, the shape of the usual registry file."""
    entry = (
        "name string, url string, domain string, language string, country string, category string, "
        "source_type string, enabled boolean"
    )
    schema = (
        f"feeds array<struct<{entry.replace(' string', ':string').replace(' boolean', ':boolean')}>>, "
        "primary_sources map<string,array<struct<domain:string,name:string,source_type:string>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    listed = doc.select(F.posexplode_outer("feeds").alias("feed_no", "f")).where(F.col("f").isNotNull())
    primary = doc.select(F.explode("primary_sources").alias("category", "entries")).select(
        "category", F.explode("entries").alias("e")
    ).select(
        "category", "e.domain", F.coalesce("e.name", "e.domain").alias("name"),
        F.coalesce("e.source_type", F.lit("UNKNOWN")).alias("source_type"),
    )
    known = F.col("source_type").isin(*V.SOURCE_TYPES)
    return feeds(listed.select("feed_no", "f.*")), primary.where(F.col("domain").isNotNull() & known)
