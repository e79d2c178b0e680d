"""From submissions and a corpus to verdicts: the whole job as one lazy composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.operators import claims as C
from claimloom.operators import evidence as E
from claimloom.operators import intake as I
from claimloom.operators import retrieve as R
from claimloom.operators import scores as S
from claimloom.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """How much of everything a run looks at; None means all of it."""

    sentences: int | None = V.MAX_SENTENCES
    queries: int = 4  # a claim has no more than four
    documents: int | None = V.DOCUMENTS_PER_CLAIM
    passages: int | None = V.PASSAGES_PER_DOCUMENT
    shortest_passage: int | None = V.PASSAGE_MIN
    longest_sentence: int | None = V.PASSAGE_MAX


#: All sentences, documents above the least score, and passages.
WHOLE = Limits(sentences=None, documents=None, passages=None, shortest_passage=None, longest_sentence=None)


@dataclass(frozen=True)
class Verification:
    """The tables one run produces."""

    claims: DataFrame
    candidates: DataFrame
    evidence: DataFrame
    claim_scores: DataFrame
    overall: DataFrame


def verify(
    submissions: DataFrame,
    documents: DataFrame,
    sources: DataFrame,
    origin_key: str = "item",
    materialize: bool = True,
    tokens: DataFrame | None = None,
    limits: Limits = Limits(),
) -> Verification:
    """submissions(submission_id, text, ...) against documents(doc_id, body, title, source, url,
    canonical_url, published_at, created_at) and sources(source, source_name, source_type,
    is_primary).

    The corpus is read twice: for tokens, and for the documents chosen; with `tokens` (doc_id, tokens), as a
    kept index has them, the first reading and the cutting into tokens fall away.  With materialize=True the
    claims, the chosen pairs and the chosen documents, all read several times, are checkpointed once to
    the shared folder.
    """
    spoken = I.texts_by_origin(I.with_language(submissions))
    claims = C.claim_queries(C.extract_claims(spoken, limits.sentences), limits.queries)
    if materialize:
        claims = cut_lineage(claims)
    tokened = X.with_tokens(documents.select("doc_id", "body"), "body", "tokens").drop("body") if tokens is None else tokens
    candidates = R.documents_to_read(
        R.relevance(claims, tokened, V.CANDIDATE_MIN_SCORE).withColumn("provider_no", F.lit(0)), limits.documents
    ).drop("provider_no")
    if materialize:
        candidates = cut_lineage(candidates)
    evidence, scores = judge(claims, candidates, documents, sources, origin_key, materialize, limits)
    runs = submissions.select(F.col("submission_id").alias("verification_id"), F.lit(False).alias("degraded"))
    overall = S.score_overall(scores.withColumnRenamed("submission_id", "verification_id"), runs)
    return Verification(claims, candidates, evidence, scores, overall)


def judge(
    claims: DataFrame, candidates: DataFrame, documents: DataFrame, sources: DataFrame, origin_key: str = "item", materialize: bool = True,
    limits: Limits = Limits(), penalties: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(evidence, claim scores) of claims on the documents chosen for them, candidates(claim_id, doc_id, score);
    penalties(claim_id, penalty_type), as `operators.dates` gives them, weigh on the scores."""
    chosen = documents.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.withColumn("content_hash", X.body_hash(F.col("body")))
    if materialize:
        chosen = cut_lineage(chosen)
    read = candidates.join(chosen.drop("body"), "doc_id")
    found = E.evidence_for_claims(
        claims, candidates, chosen.select("doc_id", "body"), limits.passages,
        shortest=limits.shortest_passage, longest=limits.longest_sentence,
    )
    found = E.with_origin(found, read)
    found = found.join(read.select("claim_id", "doc_id", "source"), ["claim_id", "doc_id"])
    evidence = E.with_source(found, sources)
    # live scoring takes relevance, source and origin only
    signals = evidence.select(
        "claim_id", "evidence_id", F.col("doc_id").alias("document_id"), "relationship", "relevance",
        "source_type", "is_primary", "cluster_id",
    )
    scores = S.score_claims(
        claims.select("claim_id", "submission_id", "sequence", "claim_text", "claim_type", "importance"),
        signals,
        penalties=penalties,
        origin_key=origin_key,
    )
    return evidence, scores
