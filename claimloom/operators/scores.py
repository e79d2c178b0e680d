"""Labelled evidence -> claim scores -> overall scores, as conditional aggregates.

Every step is a groupBy whose partial aggregate runs before the shuffle, so a claim or a
verification that owns a third of all evidence costs one row per map task, not one hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import scoring as S


def weighted(evidence: DataFrame) -> DataFrame:
    """Add source_factor and weight.  Missing temporal factor or directness counts as 1."""
    one = F.lit(1.0)
    columns = set(evidence.columns)
    temporal = F.coalesce(F.col("temporal_factor"), one) if "temporal_factor" in columns else one
    direct = F.coalesce(F.col("directness"), one) if "directness" in columns else one
    return evidence.withColumn(
        "source_factor", S.source_factor(F.col("source_type"), F.col("is_primary"))
    ).withColumn(
        "weight", S.evidence_weight(F.col("relevance"), F.col("source_factor"), temporal, direct)
    )


def origin_of(origin_key: str = "item") -> Column:
    """The origin an evidence row belongs to: its cluster, else itself ('item') or its document."""
    own = F.concat(F.lit("item:"), F.col("evidence_id").cast("string"))
    if origin_key == "document":
        own = F.concat(F.lit("document:"), F.col("document_id").cast("string"))
    return F.coalesce(F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")), own)


def cluster_weights(evidence: DataFrame, origin_key: str = "item") -> DataFrame:
    """One row per (claim, relationship, origin) with its damped weight."""
    return (
        weighted(evidence)
        .groupBy("claim_id", "relationship", origin_of(origin_key).alias("origin"))
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.max("weight").alias("best_weight"),
            F.sum(F.col("weight").cast(S.EXACT)).cast("double").alias("sum_weight"),
            F.max("source_factor").alias("best_factor"),
        )
        .withColumn("cluster_weight", S.damped(F.col("best_weight"), F.col("sum_weight")))
    )


def max_penalties(penalties: DataFrame) -> DataFrame:
    """Largest penalty per claim from rows of (claim_id, penalty_type)."""
    return penalties.groupBy("claim_id").agg(
        F.coalesce(F.max(S.penalty_value(F.col("penalty_type"))), F.lit(0.0)).alias("applied_penalty")
    )


def score_claims(
    claims: DataFrame,
    evidence: DataFrame,
    penalties: DataFrame | None = None,
    origin_key: str = "item",
) -> DataFrame:
    """Score every claim; a claim without evidence is UNVERIFIED by rule 1."""
    side = F.col("relationship")

    def total(which: str) -> Column:
        amount = F.sum(F.when(side == which, F.col("cluster_weight").cast(S.EXACT)))
        return F.coalesce(amount.cast("double"), F.lit(0.0))

    totals = (
        cluster_weights(evidence, origin_key)
        .groupBy("claim_id")
        .agg(
            total("SUPPORTS").alias("support_score"),
            total("CONTRADICTS").alias("contradiction_score"),
            F.count(F.when(side.isin("SUPPORTS", "CONTRADICTS"), 1)).alias("independent_origins"),
            F.max("best_factor").alias("best_factor"),
            F.sum("members").alias("evidence_count"),
        )
    )
    joined = claims.join(totals, "claim_id", "left")
    if penalties is not None:
        joined = joined.join(max_penalties(penalties), "claim_id", "left")
    else:
        joined = joined.withColumn("applied_penalty", F.lit(0.0))
    satirical = F.col("is_satirical") if "is_satirical" in claims.columns else F.lit(False)
    zero = {
        "support_score": 0.0, "contradiction_score": 0.0, "independent_origins": 0,
        "evidence_count": 0, "applied_penalty": 0.0,
    }
    s, c, n = F.col("support_score"), F.col("contradiction_score"), F.col("independent_origins")
    return (
        joined.fillna(zero)
        .withColumn("net", S.net_score(s, c))
        .withColumn("total_weight", s + c)
        .withColumn("coverage_score", S.coverage(n))
        .withColumn(
            "decision_rule",
            S.claim_rule(F.col("claim_type"), satirical, F.col("net"), s, c, n, F.col("applied_penalty")),
        )
        .withColumn("verdict", S.rule_verdict(F.col("decision_rule")))
        .withColumn("confidence_score", S.confidence(s, c, n, F.col("best_factor")))
        .withColumn("confidence_band", S.confidence_band(F.col("confidence_score"), F.col("verdict")))
    )


def claim_breakdown(scores: DataFrame) -> DataFrame:
    """One JSON-ready struct per claim, factors rounded to four places."""
    rounded = [
        S.four_places(F.col(name)).alias(name)
        for name in (
            "confidence_score", "support_score", "contradiction_score", "coverage_score", "net",
            "total_weight", "applied_penalty",
        )
    ]
    return scores.select(
        "claim_id",
        F.struct(
            "verdict", "confidence_band", *rounded, "independent_origins", "decision_rule"
        ).alias("breakdown"),
    )


def evidence_breakdown(evidence: DataFrame, origin_key: str = "item") -> DataFrame:
    """The weight of every evidence row with the factors behind it."""
    return weighted(evidence).select(
        "claim_id",
        "evidence_id",
        "relationship",
        origin_of(origin_key).alias("cluster"),
        *[
            S.four_places(F.col(name)).alias(name)
            for name in ("relevance", "source_factor", "temporal_factor", "directness", "weight")
            if name in evidence.columns or name in ("source_factor", "weight")
        ],
    )


def score_overall(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Overall verdict per run of ``runs(verification_id, degraded)``.

    Claims of importance >= 0.7 decide; with none, all do.  Both sets are counted in the same
    aggregate and the choice is made afterwards, so no window over a verification is needed.
    """
    weight = F.greatest(F.lit(0.01), F.coalesce(F.col("importance"), F.lit(0.5)))
    important = F.coalesce(F.col("importance"), F.lit(0.5)) >= V.IMPORTANT
    aggs = []
    for prefix, chosen in (("all", F.lit(True)), ("top", important)):
        aggs.append(F.count(F.when(chosen, 1)).alias(f"{prefix}_n"))
        aggs.append(F.sum(F.when(chosen, weight.cast(S.EXACT))).cast("double").alias(f"{prefix}_w"))
        aggs.append(
            F.sum(F.when(chosen, (weight * F.col("confidence_score")).cast(S.EXACT)))
            .cast("double")
            .alias(f"{prefix}_cw")
        )
        aggs += [
            F.count(F.when(chosen & (F.col("verdict") == v), 1)).alias(f"{prefix}_{v}")
            for v in V.VERDICTS
        ]
    counted = runs.join(scores.groupBy("verification_id").agg(*aggs), "verification_id", "left")
    use_top = F.coalesce(F.col("top_n"), F.lit(0)) > 0

    def pick(name: str) -> Column:
        return F.coalesce(
            F.when(use_top, F.col(f"top_{name}")).otherwise(F.col(f"all_{name}")), F.lit(0)
        )

    verdict, rule = S.overall_rule({v: pick(v) for v in V.VERDICTS}, pick("n"))
    return (
        counted.withColumn("overall_verdict", verdict)
        .withColumn("decision_rule", rule)
        .withColumn("considered_claims", pick("n"))
        .withColumn("claim_count", F.coalesce(F.col("all_n"), F.lit(0)))
        .withColumn(
            "confidence_score", F.when(pick("n") > 0, pick("cw") / pick("w")).otherwise(F.lit(0.0))
        )
        .withColumn(
            "confidence_band",
            S.overall_band(F.col("confidence_score"), F.col("overall_verdict"), F.col("degraded")),
        )
        .select(
            *runs.columns, "overall_verdict", "decision_rule", "claim_count", "considered_claims",
            "confidence_score", "confidence_band",
        )
    )
