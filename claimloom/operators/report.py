"""Reports and listings over claims, evidence, scores, stages and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import scoring as S


def label_distribution(evidence: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Evidence rows per relationship, optionally within `by`."""
    return evidence.groupBy(*(by or []), "relationship").agg(F.count(F.lit(1)).alias("n"))


def _clusters() -> Column:
    return F.count_distinct("cluster_id")


def origin_counts(evidence: DataFrame) -> DataFrame:
    """The three counts of independent origins per claim.

    scorer: per side, clusters and unclustered items; report: clusters and unclustered items;
    api: clusters and documents of unclustered items.
    """
    origin = F.coalesce(
        F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")),
        F.concat(F.lit("item:"), F.col("evidence_id").cast("string")),
    )
    side = F.col("relationship")
    alone = F.col("cluster_id").isNull()
    # One row per (claim, side, origin) first: what is left counts without DISTINCT expansion.
    per_origin = evidence.withColumn("_o", origin).groupBy("claim_id", "relationship", "_o", "cluster_id").agg(
        F.count(F.lit(1)).alias("items")
    )
    scorer = per_origin.groupBy("claim_id").agg(
        F.count(F.when(side.isin("SUPPORTS", "CONTRADICTS"), 1)).alias("scorer_origins")
    )
    shared = evidence.groupBy("claim_id").agg(
        _clusters().alias("_clusters"),
        F.count(F.when(alone, 1)).alias("_items"),
        F.count_distinct(F.when(alone, F.col("document_id"))).alias("_documents"),
    )
    return scorer.join(shared, "claim_id").select(
        "claim_id",
        "scorer_origins",
        (F.col("_clusters") + F.col("_items")).alias("report_origins"),
        (F.col("_clusters") + F.col("_documents")).alias("api_origins"),
    )


def top_publishers(evidence: DataFrame, k: int = 6) -> DataFrame:
    """The first k distinct publisher names per verification, in order.

    Names are made distinct, then ranked; only k of them are ever collected for one run.
    """
    order = Window.partitionBy("verification_id").orderBy("source_name")
    return (
        evidence.where(F.coalesce(F.col("source_name"), F.lit("")) != "")
        .select("verification_id", "source_name")
        .distinct()
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .groupBy("verification_id")
        .agg(F.sort_array(F.collect_list("source_name")).alias("publishers"))
    )


def summaries(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The summary sentence of every verification; evidence carries verification_id, source_name."""
    counted = evidence.groupBy("verification_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("relationship") == "SUPPORTS", 1)).alias("sup"),
        F.count(F.when(F.col("relationship") == "CONTRADICTS", 1)).alias("con"),
        (_clusters() + F.count(F.when(F.col("cluster_id").isNull(), 1))).alias("origins"),
    )
    joined = (
        claims.groupBy("verification_id")
        .agg(F.count(F.lit(1)).alias("n_claims"))
        .join(counted, "verification_id", "left")
        .join(top_publishers(evidence), "verification_id", "left")
        .fillna({"n": 0, "sup": 0, "con": 0, "origins": 0})
        .withColumn("publishers", F.coalesce("publishers", F.array().cast("array<string>")))
    )
    return joined.withColumn(
        "summary",
        S.summary_text(*[F.col(c) for c in ("n_claims", "n", "origins", "sup", "con", "publishers")]),
    )


def report_counters(claim_scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Totals per verification: claims, evidence by side, unresolved claims, origins."""
    per_claim = evidence.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("relationship") == "SUPPORTS", 1)).alias("sup"),
        F.count(F.when(F.col("relationship") == "CONTRADICTS", 1)).alias("con"),
        (_clusters() + F.count_distinct(F.when(F.col("cluster_id").isNull(), F.col("document_id")))).alias("origins"),
    )
    return (
        claim_scores.join(per_claim, "claim_id", "left")
        .groupBy("verification_id")
        .agg(
            F.count(F.lit(1)).alias("claims"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_evidence"),
            F.coalesce(F.sum("sup"), F.lit(0)).alias("supporting_evidence"),
            F.coalesce(F.sum("con"), F.lit(0)).alias("contradicting_evidence"),
            F.coalesce(F.sum("origins"), F.lit(0)).alias("independent_origins"),
            F.count(F.when(unresolved(F.col("verdict")), 1)).alias("unresolved_claims"),
        )
    )


def unresolved(verdict: Column) -> Column:
    return verdict.isNull() | (verdict == "UNVERIFIED")


def shown_verdict(verdict: Column) -> Column:
    """An absent verdict is presented as UNVERIFIED."""
    return F.coalesce(verdict, F.lit("UNVERIFIED"))


def report(claim_scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per claim with its evidence nested, contradictions and supports apart.

    Evidence per claim is bounded by the retrieval caps (six documents, three passages each),
    so the nested list stays small.
    """
    item = F.struct(
        "display_rank", "doc_id", "relationship", "evidence_text", "relevance", "cluster_id",
        "document_title", "document_url",
    )
    nested = evidence.groupBy("claim_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    joined = claim_scores.join(nested, "claim_id", "left")
    def side(name: str) -> Column:
        return F.filter("evidence", lambda e: e["relationship"] == name)

    return joined.withColumn("supporting", side("SUPPORTS")).withColumn(
        "contradicting", side("CONTRADICTS")
    )


def evidence_listing(
    evidence: DataFrame, claims: DataFrame, documents: DataFrame, relationship: str | None = None
) -> DataFrame:
    """Evidence of each verification, optionally of one relationship, with document facts; `position`
    numbers a claim's evidence from the most relevant down."""
    chosen = evidence if relationship is None else evidence.where(F.col("relationship") == relationship)
    order = Window.partitionBy("claim_id").orderBy(F.desc("relevance"), "evidence_id")
    chosen = chosen.withColumn("position", F.row_number().over(order))
    return chosen.join(claims.select("claim_id", "verification_id"), "claim_id").join(
        documents, "document_id", "left"
    )


def recent(
    verifications: DataFrame,
    submissions: DataFrame,
    limit: int = 20,
    verdict: str | None = None,
    status: str | None = None,
    excerpt_chars: int | None = 280,
) -> DataFrame:
    """Newest verifications first, with an excerpt of what was submitted (the whole of it with excerpt_chars=None).

    The limit is taken before the join, so only `limit` rows look their submission up.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    rows = verifications
    if verdict is not None:
        rows = rows.where(F.col("overall_verdict") == verdict)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    head = rows.orderBy(F.desc("created_at"), F.desc("verification_id")).limit(limit)
    empty = F.lit("")
    excerpt = F.coalesce(
        F.nullif(F.col("text"), empty), F.nullif(F.col("caption"), empty), F.nullif(F.col("url"), empty)
    )
    return (
        submissions.select("submission_id", "content_type", "title", (excerpt if excerpt_chars is None else F.substring(excerpt, 1, excerpt_chars)).alias("excerpt"))
        .join(F.broadcast(head), "submission_id")
        .orderBy(F.desc("created_at"), F.desc("verification_id"))
    )


def keyset_page(rows: DataFrame, after: tuple | None, limit: int = 20) -> DataFrame:
    """The page after cursor (created_at, verification_id), newest first."""
    if after is not None:
        at, key = after
        rows = rows.where(
            (F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("verification_id") < F.lit(key)))
        )
    return rows.orderBy(F.desc("created_at"), F.desc("verification_id")).limit(limit)


def degradation_set(reasons: DataFrame) -> DataFrame:
    """reasons(verification_id, sequence, reason) -> distinct reasons in first-seen order.

    Reasons are distinct per run before they are collected: their vocabulary is closed.
    """
    first = reasons.groupBy("verification_id", "reason").agg(F.min("sequence").alias("sequence"))
    return first.groupBy("verification_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sequence", "reason"))), lambda r: r["reason"]).alias("reasons")
    ).withColumn("degraded", F.size("reasons") > 0)


def applicable_stages(runs: DataFrame) -> DataFrame:
    """(verification_id, sequence, stage, label) for runs(verification_id, has_media)."""
    stages = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.lit(V.STAGE_LABELS[s]).alias("label"))
            for s in V.STAGE_SEQUENCE
        ]
    )
    fitting = F.filter(stages, lambda s: (s["stage"] != "ANALYZING_MEDIA") | F.col("has_media"))
    return runs.select("verification_id", F.posexplode(fitting).alias("pos", "s")).select(
        "verification_id", (F.col("pos") + 1).alias("sequence"), "s.*"
    )


def latest_stages(log: DataFrame) -> DataFrame:
    """Latest row per (verification, stage) of log(verification_id, stage, ts, event_id, status)."""
    return log.groupBy("verification_id", "stage").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts")
    )


def pending_stages(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Applicable stages not yet done: where a redelivered job resumes."""
    done = latest_stages(log).where(F.col("status").isin(*V.DONE_STAGE_STATUSES))
    return applicable_stages(runs).join(done, ["verification_id", "stage"], "left_anti")


def stage_progress(runs: DataFrame, log: DataFrame) -> DataFrame:
    """stage_index (done) out of stage_count (applicable) per run."""
    done = latest_stages(log).where(F.col("status").isin(*V.DONE_STAGE_STATUSES))
    n_done = done.groupBy("verification_id").agg(F.count(F.lit(1)).alias("stage_index"))
    n_all = F.lit(len(V.STAGE_SEQUENCE)) - F.when(F.col("has_media"), 0).otherwise(1)
    return runs.select("verification_id", n_all.alias("stage_count")).join(n_done, "verification_id", "left").fillna(
        {"stage_index": 0}
    )


def stage_state(runs: DataFrame, log: DataFrame) -> DataFrame:
    """State of each run from the stage log: a failed fatal stage ends it with no verdict, any other
    failed stage degrades it under the reason ``<stage>_failed``.  It is complete once every stage
    that applies has ended, running until then, and queued while none has begun."""
    rows = applicable_stages(runs).select("verification_id", "stage")
    rows = rows.join(latest_stages(log).select("verification_id", "stage", "status"), ["verification_id", "stage"], "left")
    begun = F.col("status").isNotNull()
    failed = F.coalesce(F.col("status") == "FAILED", F.lit(False))
    fatal = failed & F.col("stage").isin(*V.FATAL_STAGES)
    soft = failed & ~F.col("stage").isin(*V.FATAL_STAGES)
    ended = failed | F.coalesce(F.col("status").isin(*V.DONE_STAGE_STATUSES), F.lit(False))
    return rows.groupBy("verification_id").agg(
        F.when(F.max(fatal), "FAILED").when(F.min(ended), "COMPLETED").when(F.max(begun), "RUNNING").otherwise("QUEUED").alias("status"),
        F.array_join(
            F.sort_array(F.collect_set(F.when(soft, F.concat(F.lower("stage"), F.lit("_failed"))))), ","
        ).alias("degradation_reasons"),
        F.max(soft).alias("degraded"),
    ).withColumn("verdict_is_null", F.col("status") != "COMPLETED")


def stage_durations(rows: DataFrame) -> DataFrame:
    """Milliseconds per stage and idle time before it; running stages have null duration."""
    order = Window.partitionBy("verification_id").orderBy("sequence")
    ms = lambda a, b: ((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long")
    return rows.withColumn("duration_ms", ms(F.col("started_at"), F.col("finished_at"))).withColumn(
        "idle_ms", ms(F.lag("finished_at").over(order), F.col("started_at"))
    )


def revision_numbers(outcomes: DataFrame) -> DataFrame:
    """Number the outcomes of each verification by completion and flag verdict changes."""
    order = Window.partitionBy("verification_id").orderBy("completed_at", "outcome_id")
    return (
        outcomes.withColumn("revision_number", F.row_number().over(order))
        .withColumn("previous_verdict", F.lag("verdict").over(order))
        .withColumn(
            "changed", F.coalesce(F.col("previous_verdict") != F.col("verdict"), F.lit(False))
        )
    )


def sources_checked(candidates: DataFrame) -> DataFrame:
    """Publishers looked at per verification with document counts and best score."""
    return candidates.groupBy("verification_id", "domain").agg(
        F.count_distinct("doc_id").alias("documents"), F.max("score").alias("best_score")
    )


def existing_jobs(jobs: DataFrame, verifications: DataFrame) -> DataFrame:
    """Jobs whose verification still exists."""
    return jobs.join(verifications.select("verification_id"), "verification_id", "left_semi")


def calibration(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Count and share of each label per verdict for verdicts(doc_id, verdict), labels(doc_id, label)."""
    joined = verdicts.join(labels, "doc_id")
    return joined.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positives"),
        (F.sum("label") / F.count(F.lit(1))).alias("accuracy"),
    )
