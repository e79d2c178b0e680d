"""Submissions: validation, routing by kind, texts by origin, detected language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.functions import web as U


def _kind(has_text: Column) -> Column:
    media = F.col("media_kind")
    captioned = F.coalesce(F.col("caption"), F.lit("")) != ""
    return (
        F.when(F.col("url").isNotNull(), F.when(U.is_social_host(U.host(F.col("url"))), "SOCIAL_URL").otherwise("ARTICLE_URL"))
        .when((media == "IMAGE") & F.coalesce(F.col("is_screenshot"), F.lit(False)), "SCREENSHOT")
        .when((media == "IMAGE") & captioned, "IMAGE_WITH_CAPTION")
        .when(media == "IMAGE", "IMAGE")
        .when((media == "VIDEO") & captioned, "VIDEO_WITH_CAPTION")
        .when(media == "VIDEO", "VIDEO")
        .when(has_text, "TEXT")
    )


def media_kind_for(content_type: Column) -> Column:
    """The media kind a content type implies, else null."""
    return (
        F.when(content_type.isin("IMAGE", "IMAGE_WITH_CAPTION"), "IMAGE")
        .when(content_type == "SCREENSHOT", "SCREENSHOT")
        .when(content_type.isin("VIDEO", "VIDEO_WITH_CAPTION"), "VIDEO")
    )


def intake(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw(submission_id, text, title, url, caption, media_kind, is_screenshot) into
    (accepted, rejected); rejected rows carry a reject_reason.  Missing columns read as null.

    Length limits apply to the text as sent; what is stored is stripped.
    """
    df = raw
    for name, kind in (
        ("text", "string"), ("title", "string"), ("url", "string"), ("caption", "string"),
        ("media_kind", "string"), ("is_screenshot", "boolean"),
    ):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    text, url = F.col("text"), F.col("url")
    reason = (
        F.when(url.isNull() & text.isNull() & F.col("media_kind").isNull(), "nothing_submitted")
        .when(text.isNotNull() & ~F.length(text).between(10, 50_000), "text_length")
        .when(text.isNotNull() & (X.strip(text) == ""), "blank_text")
        .when(F.length("title") > 500, "title_length")
        .when(url.isNotNull() & ~F.length(url).between(8, 2048), "url_length")
        .when(url.isNotNull() & (F.length("caption") > 2000), "note_length")
    )
    judged = df.withColumn("reject_reason", reason)
    judged = judged.withColumn("content_type", _kind(text.isNotNull()))
    accepted = (
        judged.where(F.col("reject_reason").isNull())
        .drop("reject_reason")
        .withColumn("text", X.strip(text))
        .withColumn("url", X.strip(url))
        .withColumn(
            "content_hash",
            F.when(F.col("url").isNotNull(), X.submission_hash(F.col("url")))
            .when(F.col("text").isNotNull(), X.submission_hash(F.col("text"), F.col("title"))),
        )
    )
    return accepted, judged.where(F.col("reject_reason").isNotNull())


# Which column speaks with which voice, in claim order.
ORIGIN_COLUMNS = (
    ("text", "USER_TEXT"), ("caption", "USER_CAPTION"), ("article", "ARTICLE_TEXT"), ("ocr", "OCR_TEXT"),
)


def ocr_by_submission(assets: DataFrame) -> DataFrame:
    """Text read from each asset, joined by newline in asset order, per submission."""
    return (
        assets.where(~X.is_blank(F.col("ocr_text")))
        .groupBy("submission_id")
        .agg(F.sort_array(F.collect_list(F.struct("asset_no", "ocr_text"))).alias("parts"))
        .select("submission_id", F.array_join(F.col("parts.ocr_text"), "\n").alias("ocr"))
    )


def texts_by_origin(submissions: DataFrame) -> DataFrame:
    """(submission_id, [language,] origin_no, origin, text) for every non-empty text column."""
    keys = [c for c in ("submission_id", "language") if c in submissions.columns]
    voices = [
        F.struct(F.lit(i).alias("origin_no"), F.lit(origin).alias("origin"), F.col(c).alias("text"))
        for i, (c, origin) in enumerate(ORIGIN_COLUMNS)
        if c in submissions.columns
    ]
    return (
        submissions.select(*keys, F.explode(F.array(*voices)).alias("v"))
        .select(*keys, "v.*")
        .where(F.coalesce(F.col("text"), F.lit("")) != "")
    )


def nothing_to_verify(submissions: DataFrame) -> DataFrame:
    """Submissions without any text, URL or media: the error rows of text collection."""
    empty = F.lit(True)
    for c in ("text", "caption", "url", "media_kind"):
        if c in submissions.columns:
            empty = empty & (F.coalesce(F.col(c), F.lit("")) == "")
    return submissions.where(empty)


def with_language(submissions: DataFrame) -> DataFrame:
    """Language of the combined texts of each submission (its few origin columns, in order)."""
    present = [F.nullif(F.col(c), F.lit("")) for c, _ in ORIGIN_COLUMNS if c in submissions.columns]
    return (
        submissions.withColumn("_all", F.concat_ws(" ", *present))
        .withColumn("_shares", X.script_distribution(F.col("_all")))
        .withColumn("language", X.detect_language(F.col("_all"), F.col("_shares"))["language"])
        .drop("_all", "_shares")
    )
