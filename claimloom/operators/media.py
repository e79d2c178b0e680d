"""Media jobs over file bytes joined with their extracted metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import media as M


def media_signature(files: DataFrame) -> DataFrame:
    """files(media_id, content, declared_type, kind) -> detected type, size, refusal reason."""
    return files.withColumn("detected_type", M.detect_type(F.col("content"))).select(
        "media_id",
        "kind",
        "declared_type",
        "detected_type",
        F.octet_length("content").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        M.upload_verdict(F.col("content"), F.col("declared_type"), F.col("kind"), F.col("detected_type")).alias("refusal"),
    )


def media_signals(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Provenance findings of files(media_id, content) with metadata(media_id, metadata_text,
    make, model, has_exif, software, captured_raw)."""
    facts = (
        files.select("media_id", M.has_c2pa(F.col("content")).alias("has_c2pa"))
        .join(metadata, "media_id", "left")
        .withColumn("generator", M.generator(F.col("metadata_text")))
        .withColumn("captured_at", M.exif_time(F.col("captured_raw")))
        .withColumn("has_exif", F.coalesce("has_exif", F.lit(False)))
    )
    return facts.select(
        "media_id",
        "generator",
        "has_c2pa",
        "captured_at",
        M.assessment(F.col("generator"), F.col("has_c2pa")).alias("assessment"),
        M.signals(
            F.col("generator"), F.col("has_c2pa"), F.col("make"), F.col("model"), F.col("has_exif"),
            F.col("software"), F.col("captured_at"),
        ).alias("signals"),
    )
