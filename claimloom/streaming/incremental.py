"""Verification of submissions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimloom.operators.corpus_index import CorpusIndex
from claimloom.operators.intake import intake
from claimloom.plans.verify import verify


def verify_stream(
    submissions: DataFrame, documents: DataFrame, sources: DataFrame, out: str, checkpoint: str, index: CorpusIndex | None = None
):
    """Start a stream that runs the batch job on every micro-batch against a static corpus.

    With an index, its tokens are read as they stand when a micro-batch begins, and no text is cut
    into tokens but the submissions'.
    Each batch overwrites its own epoch folder, so a batch that is run again after a failure
    leaves one copy of its results.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        accepted, rejected = intake(batch)
        result = verify(accepted, documents, sources, tokens=index.tokens() if index else None)
        for name, table in (
            ("claims", result.claims), ("evidence", result.evidence), ("claim_scores", result.claim_scores),
            ("overall", result.overall), ("rejected", rejected),
        ):
            table.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    return (
        submissions.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(run)
        .trigger(availableNow=True)
        .start()
    )
