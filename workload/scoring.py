"""Scoring queries.  Evidence is read off lineitem, claims off orders, runs off customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import scoring as FS
from claimloom.operators import report as R
from claimloom.operators import scores as S
from workload.base import quoted, sql_case, table

_TYPES = list(V.SOURCE_TYPES)
_CLAIM_TYPES = list(V.CLAIM_TYPES)
_PENALTIES = list(V.PENALTIES)


def _nth(items: list[str], position):
    return F.element_at(F.array(*[F.lit(i) for i in items]), (position + 1).cast("int"))


def evidence(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("claim_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
        F.col("l_partkey").alias("document_id"),
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey") % 3).alias("cluster_id"),
        F.when(F.col("l_returnflag") == "A", "SUPPORTS")
        .when(F.col("l_returnflag") == "R", "CONTRADICTS")
        .otherwise("NEUTRAL")
        .alias("relationship"),
        (F.col("l_discount") * 10).alias("relevance"),
        _nth(_TYPES, F.col("l_suppkey") % len(_TYPES)).alias("source_type"),
        (F.col("l_partkey") % 5 == 0).alias("is_primary"),
        (F.lit(0.4) + F.lit(0.1) * (F.col("l_partkey") % 7)).alias("temporal_factor"),
        (F.lit(0.5) + F.col("l_quantity") / 50.0).alias("directness"),
        F.when(F.col("l_tax") >= 0.07, _nth(_PENALTIES, F.col("l_linenumber") % len(_PENALTIES))).alias("penalty_type"),
    )


def claims(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("verification_id"),
        _nth(_CLAIM_TYPES, F.col("o_orderkey") % len(_CLAIM_TYPES)).alias("claim_type"),
        ((F.col("o_custkey") + F.col("o_orderkey")) % 10 / 10.0).alias("importance"),
        (F.col("o_orderkey") % 23 == 0).alias("is_satirical"),
    )


def runs(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("verification_id"), (F.col("c_nationkey") % 4 == 0).alias("degraded")
    )


def penalties(spark, sf) -> DataFrame:
    return evidence(spark, sf).where(F.col("penalty_type").isNotNull()).select("claim_id", "penalty_type")


def _scores(spark, sf) -> DataFrame:
    return S.score_claims(claims(spark, sf), evidence(spark, sf), penalties(spark, sf))


def _listed(items, position: str) -> str:
    return f"([{quoted(items)}])[({position}) + 1]"


EVIDENCE = f"""
ev AS (
  SELECT l_orderkey AS claim_id,
         l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS evidence_id,
         l_partkey AS document_id, l_suppkey AS source_id,
         CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 3 END AS cluster_id,
         CASE l_returnflag WHEN 'A' THEN 'SUPPORTS' WHEN 'R' THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS relationship,
         l_discount * 10 AS relevance,
         {_listed(_TYPES, f"l_suppkey % {len(_TYPES)}")} AS source_type,
         l_partkey % 5 = 0 AS is_primary,
         0.4::DOUBLE + 0.1::DOUBLE * (l_partkey % 7) AS temporal_factor,
         0.5::DOUBLE + l_quantity / 50.0::DOUBLE AS directness,
         CASE WHEN l_tax >= 0.07 THEN {_listed(_PENALTIES, f"l_linenumber % {len(_PENALTIES)}")} END AS penalty_type
  FROM lineitem),
claims AS (
  SELECT o_orderkey AS claim_id, o_custkey AS verification_id,
         {_listed(_CLAIM_TYPES, f"o_orderkey % {len(_CLAIM_TYPES)}")} AS claim_type,
         ((o_custkey + o_orderkey) % 10)::DOUBLE / 10.0::DOUBLE AS importance,
         o_orderkey % 23 = 0 AS is_satirical
  FROM orders),
weighted AS (
  SELECT *, CASE WHEN cluster_id IS NULL THEN 'item:'||evidence_id ELSE 'cluster:'||cluster_id END AS origin,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, relevance)) * source_factor
           * greatest(0.0::DOUBLE, least(1.0::DOUBLE, temporal_factor))
           * greatest(0.0::DOUBLE, least(1.0::DOUBLE, directness)) AS weight
  FROM (SELECT *, greatest(0.5::DOUBLE, least(1.3::DOUBLE,
          {sql_case("source_type", {k: f"{v}::DOUBLE" for k, v in V.SOURCE_FACTORS.items()})}
          + CASE WHEN is_primary THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) AS source_factor FROM ev)),
clusters AS (
  SELECT *, best_weight + 0.15::DOUBLE * (sum_weight - best_weight) AS cluster_weight FROM (
    SELECT claim_id, relationship, origin, count(*) AS members, max(weight) AS best_weight,
           sum(weight::DECIMAL(20,12))::DOUBLE AS sum_weight, max(source_factor) AS best_factor
    FROM weighted GROUP BY ALL)),
penalty AS (
  SELECT claim_id, max({sql_case("penalty_type", {k: f"{v}::DOUBLE" for k, v in V.PENALTIES.items()})}) AS applied_penalty
  FROM ev WHERE penalty_type IS NOT NULL GROUP BY claim_id),
totals AS (
  SELECT claim_id,
         coalesce(sum(CASE WHEN relationship = 'SUPPORTS' THEN cluster_weight::DECIMAL(20,12) END)::DOUBLE, 0) AS s,
         coalesce(sum(CASE WHEN relationship = 'CONTRADICTS' THEN cluster_weight::DECIMAL(20,12) END)::DOUBLE, 0) AS c,
         count(*) FILTER (relationship IN ('SUPPORTS', 'CONTRADICTS')) AS n,
         max(best_factor) AS best_factor, sum(members)::BIGINT AS evidence_count
  FROM clusters GROUP BY claim_id),
joined AS (
  SELECT claims.*, coalesce(s, 0) AS s, coalesce(c, 0) AS c, coalesce(n, 0) AS n, best_factor,
         coalesce(evidence_count, 0) AS evidence_count, coalesce(applied_penalty, 0) AS p
  FROM claims LEFT JOIN totals USING (claim_id) LEFT JOIN penalty USING (claim_id)),
ruled AS (
  SELECT *, CASE
      WHEN s + c < 0.45 OR n = 0 THEN 1
      WHEN claim_type IN ('OPINION', 'PREDICTION') THEN 2
      WHEN is_satirical THEN 3
      WHEN net >= 0.6 AND p >= 0.35 THEN 4
      WHEN net >= 0.6 AND p > 0 THEN 5
      WHEN net >= 0.75 AND n >= 3 AND s >= 2 THEN 6
      WHEN net >= 0.5 THEN 7
      WHEN net <= -0.75 AND n >= 2 AND c >= 1.5 THEN 8
      WHEN net <= -0.4 THEN 9
      WHEN s > 0 AND c > 0 THEN 10
      ELSE 11 END AS decision_rule
  FROM (SELECT *, CASE WHEN s + c > 1e-9 THEN (s - c) / (s + c) ELSE 0 END AS net FROM joined)),
scored AS (
  SELECT *, ([{quoted(FS.CLAIM_RULES[i] for i in range(1, 12))}])[decision_rule] AS verdict,
         least(1.0::DOUBLE, n / 3.0::DOUBLE) AS coverage_score,
         0.40::DOUBLE * least(1.0::DOUBLE, n / 3.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, (s + c) / 4.0::DOUBLE)
           + 0.20::DOUBLE * CASE WHEN s + c > 1e-9 THEN 1.0::DOUBLE - least(s, c) / (s + c) ELSE 0 END
           + 0.15::DOUBLE * coalesce((best_factor - 0.5::DOUBLE) / (1.3::DOUBLE - 0.5::DOUBLE), 0) AS confidence_score
  FROM ruled),
claim_scores AS (
  SELECT *, CASE WHEN verdict = 'UNVERIFIED' THEN 'LOW' WHEN confidence_score >= 0.7 THEN 'HIGH'
                 WHEN confidence_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band
  FROM scored)
"""

_V = "FALSE MISLEADING LIKELY_FALSE SATIRE OPINION PARTLY_TRUE VERIFIED LIKELY_TRUE UNVERIFIED".split()
OVERALL = f"""
imp AS (SELECT *, greatest(0.01::DOUBLE, importance) AS w,
               max(importance >= 0.7) OVER (PARTITION BY verification_id) AS any_top FROM claim_scores),
considered AS (SELECT * FROM imp WHERE importance >= 0.7 OR NOT any_top),
counted AS (
  SELECT verification_id, count(*) AS total, sum(w::DECIMAL(20,12))::DOUBLE AS sw,
         sum((w * confidence_score)::DECIMAL(20,12))::DOUBLE AS sc,
         {", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in _V)}
  FROM considered GROUP BY verification_id),
all_claims AS (SELECT verification_id, count(*) AS claim_count FROM claim_scores GROUP BY verification_id),
runs AS (SELECT c_custkey AS verification_id, c_nationkey % 4 = 0 AS degraded FROM customer),
decided AS (
  SELECT runs.*, coalesce(claim_count, 0) AS claim_count, coalesce(total, 0) AS considered_claims,
    coalesce(sc / sw, 0) AS confidence_score,
    CASE WHEN total IS NULL THEN 'UNVERIFIED:0' WHEN n_FALSE > 0 THEN 'FALSE:1' WHEN n_MISLEADING > 0 THEN 'MISLEADING:2'
      WHEN n_LIKELY_FALSE > 0 THEN 'LIKELY_FALSE:3' WHEN n_SATIRE = total THEN 'SATIRE:8'
      WHEN n_OPINION = total THEN 'OPINION:8' WHEN n_PARTLY_TRUE > 0 THEN 'PARTLY_TRUE:4'
      WHEN total - n_SATIRE - n_OPINION > 0 AND n_VERIFIED = total - n_SATIRE - n_OPINION THEN 'VERIFIED:5'
      WHEN total - n_SATIRE - n_OPINION > 0 AND n_VERIFIED + n_LIKELY_TRUE = total - n_SATIRE - n_OPINION THEN 'LIKELY_TRUE:6'
      WHEN n_UNVERIFIED > 0 AND n_UNVERIFIED * 2 >= total THEN 'UNVERIFIED:7'
      WHEN n_VERIFIED + n_LIKELY_TRUE > 0 AND n_UNVERIFIED > 0 THEN 'PARTLY_TRUE:4' ELSE 'UNVERIFIED:7' END AS d
  FROM runs LEFT JOIN counted USING (verification_id) LEFT JOIN all_claims USING (verification_id)),
overall AS (
  SELECT *, split_part(d, ':', 1) AS overall_verdict, split_part(d, ':', 2)::INT AS decision_rule,
    CASE WHEN split_part(d, ':', 1) = 'UNVERIFIED' THEN 'LOW'
         WHEN confidence_score >= 0.7 THEN CASE WHEN degraded THEN 'MEDIUM' ELSE 'HIGH' END
         WHEN confidence_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band
  FROM decided)
"""


def _six(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def source_factor(spark, sf):
    return S.weighted(evidence(spark, sf)).select("evidence_id", "claim_id", "source_type", "is_primary", *_six("source_factor"))


def evidence_weight(spark, sf):
    return S.weighted(evidence(spark, sf)).select("evidence_id", "claim_id", *_six("weight"))


def cluster_weight(spark, sf):
    return S.cluster_weights(evidence(spark, sf)).select(
        "claim_id", "relationship", "origin", "members", *_six("best_weight", "sum_weight", "cluster_weight")
    )


def claim_score(spark, sf):
    return _scores(spark, sf).select(
        "claim_id", "independent_origins", "evidence_count",
        *_six("support_score", "contradiction_score", "net", "total_weight", "coverage_score"),
    )


def claim_verdict(spark, sf):
    return _scores(spark, sf).select("claim_id", "claim_type", "decision_rule", "verdict")


def confidence_band(spark, sf):
    return _scores(spark, sf).select("claim_id", "confidence_band", *_six("confidence_score"))


def penalty_max(spark, sf):
    return S.max_penalties(penalties(spark, sf))


def overall_verdict(spark, sf):
    return S.score_overall(_scores(spark, sf), runs(spark, sf)).select(
        "verification_id", "overall_verdict", "decision_rule", "claim_count", "considered_claims",
        "confidence_band", *_six("confidence_score"),
    )


def score_breakdown(spark, sf):
    b = S.claim_breakdown(_scores(spark, sf))
    return b.select("claim_id", "breakdown.*")


def evidence_breakdown(spark, sf):
    return S.evidence_breakdown(evidence(spark, sf))


def _verified_evidence(spark, sf):
    return evidence(spark, sf).join(claims(spark, sf).select("claim_id", "verification_id"), "claim_id")


def summary_text(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    ev = _verified_evidence(spark, sf).join(names, "source_id", "left")
    return R.summaries(claims(spark, sf), ev).select("verification_id", "summary")


def origin_counts(spark, sf):
    return R.origin_counts(evidence(spark, sf))


def origin_key_document(spark, sf):
    return S.score_claims(claims(spark, sf), evidence(spark, sf), penalties(spark, sf), origin_key="document").select(
        "claim_id", "independent_origins", "verdict", *_six("support_score", "contradiction_score")
    )


QUERIES = {f.__name__: f for f in (
    source_factor, evidence_weight, cluster_weight, claim_score, claim_verdict, confidence_band,
    penalty_max, overall_verdict, score_breakdown, evidence_breakdown, summary_text, origin_counts,
    origin_key_document,
)}

_W = "WITH" + EVIDENCE
ORACLES = {
    "source_factor": _W + "SELECT evidence_id, claim_id, source_type, is_primary, round(source_factor, 6) AS source_factor FROM weighted",
    "evidence_weight": _W + "SELECT evidence_id, claim_id, round(weight, 6) AS weight FROM weighted",
    "cluster_weight": _W + """SELECT claim_id, relationship, origin, members, round(best_weight, 6) AS best_weight,
        round(sum_weight, 6) AS sum_weight, round(cluster_weight, 6) AS cluster_weight FROM clusters""",
    "claim_score": _W + """SELECT claim_id, n AS independent_origins, evidence_count, round(s, 6) AS support_score,
        round(c, 6) AS contradiction_score, round(net, 6) AS net, round(s + c, 6) AS total_weight,
        round(coverage_score, 6) AS coverage_score FROM claim_scores""",
    "claim_verdict": _W + "SELECT claim_id, claim_type, decision_rule, verdict FROM claim_scores",
    "confidence_band": _W + "SELECT claim_id, confidence_band, round(confidence_score, 6) AS confidence_score FROM claim_scores",
    "penalty_max": _W + "SELECT * FROM penalty",
    "overall_verdict": _W + "," + OVERALL + """SELECT verification_id, overall_verdict, decision_rule, claim_count,
        considered_claims, confidence_band, round(confidence_score, 6) AS confidence_score FROM overall""",
    "score_breakdown": _W + """SELECT claim_id, verdict, confidence_band, round((confidence_score)::DECIMAL(20,12), 4)::DOUBLE AS confidence_score,
        round((s)::DECIMAL(20,12), 4)::DOUBLE AS support_score, round((c)::DECIMAL(20,12), 4)::DOUBLE AS contradiction_score, round((coverage_score)::DECIMAL(20,12), 4)::DOUBLE AS coverage_score,
        round((net)::DECIMAL(20,12), 4)::DOUBLE AS net, round((s + c)::DECIMAL(20,12), 4)::DOUBLE AS total_weight, round((p)::DECIMAL(20,12), 4)::DOUBLE AS applied_penalty,
        n AS independent_origins, decision_rule FROM claim_scores""",
    "evidence_breakdown": _W + """SELECT claim_id, evidence_id, relationship, origin AS cluster, round((relevance)::DECIMAL(20,12), 4)::DOUBLE AS relevance,
        round((source_factor)::DECIMAL(20,12), 4)::DOUBLE AS source_factor, round((temporal_factor)::DECIMAL(20,12), 4)::DOUBLE AS temporal_factor,
        round((directness)::DECIMAL(20,12), 4)::DOUBLE AS directness, round((weight)::DECIMAL(20,12), 4)::DOUBLE AS weight FROM weighted""",
    "origin_counts": _W + """SELECT claim_id,
        count(DISTINCT CASE WHEN relationship = 'SUPPORTS' THEN origin END)
          + count(DISTINCT CASE WHEN relationship = 'CONTRADICTS' THEN origin END) AS scorer_origins,
        count(DISTINCT cluster_id) + count(*) FILTER (cluster_id IS NULL) AS report_origins,
        count(DISTINCT cluster_id) + count(DISTINCT CASE WHEN cluster_id IS NULL THEN document_id END) AS api_origins
        FROM weighted GROUP BY claim_id""",
    "origin_key_document": _W.replace("'item:'||evidence_id", "'document:'||document_id") + """SELECT claim_id,
        n AS independent_origins, verdict, round(s, 6) AS support_score, round(c, 6) AS contradiction_score FROM claim_scores""",
    "summary_text": _W + """, ve AS (SELECT ev.*, verification_id, s_name FROM ev JOIN claims USING (claim_id)
          LEFT JOIN supplier ON s_suppkey = source_id),
      k AS (SELECT verification_id, count(*) AS n_claims FROM claims GROUP BY 1),
      a AS (SELECT verification_id, count(*) AS n, count(*) FILTER (relationship = 'SUPPORTS') AS sup,
              count(*) FILTER (relationship = 'CONTRADICTS') AS con,
              count(DISTINCT cluster_id) + count(*) FILTER (cluster_id IS NULL) AS o,
              array_to_string(list_sort(list_distinct(list(s_name) FILTER (s_name IS NOT NULL)))[1:6], ', ') AS pubs FROM ve GROUP BY 1)
      SELECT verification_id, CASE WHEN n IS NULL THEN
        'We identified '||n_claims||' factual '||CASE WHEN n_claims = 1 THEN 'claim' ELSE 'claims' END
        ||' in this submission and searched our indexed news sources, but found nothing relevant enough to confirm or contradict '
        ||CASE WHEN n_claims = 1 THEN 'it' ELSE 'them' END
        ||'. That means the claim is unverified — it does not mean it is false. Our coverage is limited to the sources we index, so absence here is not absence everywhere.'
      ELSE 'We identified '||n_claims||' factual '||CASE WHEN n_claims = 1 THEN 'claim' ELSE 'claims' END||' and examined '||n
        ||' passages from '||o||' independent '||CASE WHEN o = 1 THEN 'source' ELSE 'sources' END||'. '
        ||CASE WHEN sup > 0 AND con > 0 THEN sup||' passage'||CASE WHEN sup = 1 THEN '' ELSE 's' END||' supported the claims and '||con||' contradicted them.'
               WHEN sup > 0 THEN sup||' passage'||CASE WHEN sup = 1 THEN '' ELSE 's' END||' supported the claims.'
               WHEN con > 0 THEN con||' passage'||CASE WHEN con = 1 THEN '' ELSE 's' END||' contradicted the claims.'
               ELSE 'The passages we found were related but did not settle the claims either way.' END
        ||CASE WHEN pubs <> '' THEN ' Sources checked: '||pubs||'.' ELSE '' END END AS summary
      FROM k LEFT JOIN a USING (verification_id)""",
}
