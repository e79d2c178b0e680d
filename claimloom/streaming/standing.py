"""Standing claims met by arriving documents.

Registered claims wait with their probes (the discriminating tokens of their queries).  Documents arrive in
micro-batches; each batch meets the stored probes in an equality join, which gives the claims it touches.
Only these are read from the store, scored against the batch, and, where the batch holds a candidate for
them, judged again on the best documents seen so far, as a new revision.  After any number of batches the last
revision of every claim is what one run over all documents gives.

    claims/shelf=s/          registered claims, by hash of their id
    probes/bucket=b/         probe, claim_id
    documents/epoch=e/       documents as they came
    candidates/epoch=e/      claim_id, doc_id, score of each batch
    revisions/epoch=e/       claim scores, revision, and the first revision of all at epoch=-1

Each batch overwrites its own epoch folders, so one that is run again after a failure leaves one copy; it
reads earlier epochs only.  Claims are registered before the stream begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.operators import retrieve as R
from claimloom.operators.skew import salted_join, spread
from claimloom.plans.verify import judge
from claimloom.session import cut_lineage

BUCKETS = 64
SHELVES = 64


@dataclass(frozen=True)
class StandingClaims:
    """Claims that wait in a folder."""

    spark: SparkSession
    root: str
    sources: DataFrame

    def register(self, claims: DataFrame, documents: DataFrame) -> None:
        """Store claims as built by `claim_queries` and give each its first revision, without evidence.
        `documents` names the columns of what will arrive; its rows are not read."""
        claims = cut_lineage(claims)
        shelf = F.pmod(F.xxhash64("claim_id"), F.lit(SHELVES)).cast("int")
        claims.withColumn("shelf", shelf).repartition("shelf").write.partitionBy("shelf").parquet(f"{self.root}/claims")
        probes = X.unnest(R.query_profiles(claims), ["claim_id"], F.col("probes"), "probe")
        bucket = F.pmod(F.xxhash64("probe"), F.lit(BUCKETS)).cast("int")
        # in ranges, so that a probe of very many claims is written by several tasks
        dealt = probes.withColumn("bucket", bucket).repartitionByRange("bucket", "probe", "claim_id")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/probes")
        none = self.spark.createDataFrame([], "claim_id string, doc_id long, score double")
        self._revise(claims, none, documents.limit(0), -1)

    def _epochs(self, kind: str, like: DataFrame, epoch: int) -> DataFrame:
        """What epochs up to this one wrote, with the columns of `like`."""
        schema = StructType([*like.schema.fields, StructField("epoch", IntegerType())])
        held = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        return held.where(F.col("epoch") <= epoch).drop("epoch")

    def claims(self, ids: DataFrame) -> DataFrame:
        """Registered claims with these ids (claim_id), read from their shelves."""
        held = self.spark.read.parquet(f"{self.root}/claims")
        shelves = [r["s"] for r in ids.select(F.pmod(F.xxhash64("claim_id"), F.lit(SHELVES)).cast("int").alias("s")).distinct().collect()]  # SHELVES at most
        return held.where(F.col("shelf").isin(shelves)).join(ids, "claim_id", "left_semi").drop("shelf")

    def revisions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/revisions")

    def latest(self) -> DataFrame:
        """The last revision of every claim."""
        order = Window.partitionBy("claim_id").orderBy(F.desc("revision"))
        return self.revisions().withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "epoch")

    def _revise(self, claims: DataFrame, candidates: DataFrame, documents: DataFrame, epoch: int) -> None:
        _, scores = judge(claims, candidates, documents, self.sources)
        if epoch < 0:
            scores = scores.withColumn("revision", F.lit(1))
        else:
            before = self.revisions().where(F.col("epoch") < epoch).join(claims.select("claim_id"), "claim_id", "left_semi")
            last = before.groupBy("claim_id").agg((F.max("revision") + 1).alias("revision"))
            scores = scores.join(last, "claim_id")
        scores.write.mode("overwrite").parquet(f"{self.root}/revisions/epoch={epoch}")

    def touched(self, tokened: DataFrame) -> DataFrame:
        """claim_id of claims that share a discriminating token with documents(doc_id, tokens)."""
        arriving = X.unnest(tokened, [], F.filter(F.array_distinct("tokens"), X.is_discriminating), "probe").distinct()
        arriving = cut_lineage(arriving.withColumn("bucket", F.pmod(F.xxhash64("probe"), F.lit(BUCKETS)).cast("int")))
        buckets = [r["bucket"] for r in arriving.select("bucket").distinct().collect()]  # BUCKETS at most
        held = self.spark.read.parquet(f"{self.root}/probes").where(F.col("bucket").isin(buckets))
        return salted_join(held, arriving.select("probe"), "probe", ["claim_id"]).select("claim_id").distinct()

    def meet(self, documents: DataFrame, epoch: int) -> None:
        """Take a micro-batch of documents as `verify` takes them."""
        documents = cut_lineage(spread(documents))  # a micro-batch may be one file, whose texts all tasks should share
        tokened = cut_lineage(X.with_tokens(documents.select("doc_id", "body"), "body", "tokens").drop("body"))
        claims = cut_lineage(self.claims(cut_lineage(self.touched(tokened))))
        found = cut_lineage(R.relevance(claims, tokened, V.CANDIDATE_MIN_SCORE).select("claim_id", "doc_id", "score"))
        documents.write.mode("overwrite").parquet(f"{self.root}/documents/epoch={epoch}")
        found.write.mode("overwrite").parquet(f"{self.root}/candidates/epoch={epoch}")
        changed = cut_lineage(found.select("claim_id").distinct())
        every = self._epochs("candidates", found, epoch).join(changed, "claim_id", "left_semi")
        best = cut_lineage(R.documents_to_read(every.withColumn("provider_no", F.lit(0))).drop("provider_no"))
        texts = self._epochs("documents", documents, epoch)
        self._revise(claims.join(changed, "claim_id", "left_semi"), best, texts, epoch)

    def start(self, documents: DataFrame, checkpoint: str):
        """Start the stream of arriving documents."""
        return (
            documents.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(self.meet)
            .trigger(availableNow=True)
            .start()
        )
