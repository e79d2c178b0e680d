"""Texts -> atomic claims -> retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import figures as G
from claimloom.functions import text as X


def extract_claims(
    texts: DataFrame, max_claims: int | None = V.MAX_SENTENCES, parse: bool = True
) -> DataFrame:
    """texts(submission_id, origin_no, origin, text[, language]) -> one row per claim.

    The first max_claims sentences of each text are looked at, all of them with None; those under 15 characters are
    dropped.  Numbering runs over origins and then sentences.  With parse=False the parsed
    figures (money, percentages, numbers, dates, entities) are left out.
    """
    language = F.col("language") if "language" in texts.columns else F.lit("en")
    sentences = (
        X.unnest(
            texts,
            ["submission_id", "origin_no", "origin", language.alias("language")],
            X.split_sentences(F.col("text")) if max_claims is None else F.slice(X.split_sentences(F.col("text")), 1, max_claims),
            "claim_text",
            "sentence_no",
        ).where(F.length("claim_text") >= V.MIN_SENTENCE)
    )
    sentence, position = F.col("claim_text"), F.col("sentence_no")
    claims = (
        sentences.withColumn("_figure", G.has_figure(sentence))
        .withColumn("_dated", G.has_date(sentence))
        .withColumn("claim_type", G.claim_type(sentence, F.col("_figure"), F.col("_dated")))
        .withColumn(
            "importance",
            G.importance(sentence, position, F.col("claim_type"), F.col("_figure"), F.col("_dated")),
        )
        .drop("_figure", "_dated")
        .withColumn("normalized_claim", X.normalize_claim(sentence))
    )
    if parse:
        claims = (
            claims.withColumn("money", G.extract_money(sentence))
            .withColumn("percentages", G.extract_percentages(sentence))
            .withColumn("numbers", G.extract_numbers(sentence))
            .withColumn("dates", G.extract_dates(sentence))
            .withColumn("entities", G.extract_entities(sentence))
        )
    # the sentences of one submission
    order = Window.partitionBy("submission_id").orderBy("origin_no", "sentence_no")
    return claims.withColumn("sequence", F.row_number().over(order) - 1).withColumn(
        "claim_id", F.concat_ws("#", F.col("submission_id").cast("string"), F.col("sequence").cast("string"))
    )


def claim_entities(claims: DataFrame) -> DataFrame:
    """Child rows (claim_id, entity_no, entity)."""
    return X.unnest(claims, ["claim_id"], F.col("entities"), "entity", "entity_no")


def claim_queries(claims: DataFrame, max_queries: int = 4) -> DataFrame:
    """Add claim_tokens and queries: array<struct(query_no, query, tokens)>.

    Queries stay nested in their claim row: there are at most four of them.
    """
    tokened = X.with_tokens(claims, "claim_text", "claim_tokens")
    listed = tokened.withColumn(
        "_queries", X.build_queries(F.col("claim_text"), F.col("claim_tokens"), max_queries)
    )
    # the first query is the claim itself; the others are built from tokens already normalised
    head = F.transform(
        F.slice("_queries", 1, 1),
        lambda q: F.struct(F.lit(0).alias("query_no"), q.alias("query")),
    )
    head = F.zip_with(
        head,
        F.slice(F.array("claim_tokens"), 1, F.size(head)),
        lambda h, t: F.struct(h["query_no"].alias("query_no"), h["query"].alias("query"), t.alias("tokens")),
    )
    rest = F.transform(
        F.slice("_queries", 2, max_queries),
        lambda q, i: F.struct(
            (i + 1).alias("query_no"), q.alias("query"), X.tokenize(q).alias("tokens")
        ),
    )
    return listed.withColumn("queries", F.concat(head, rest)).drop("_queries")
