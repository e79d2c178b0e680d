"""Registered queries over what is kept: the corpus index, vector cells, standing claims.

The corpus index is built once for each session and table folder: four fifths of the documents, then other texts
for a tenth of these, then that tenth as it is with all that was missing.  What the queries return is
therefore that of the whole table, read through three generations with replaced documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import calibration as CA
from claimloom.operators import claims as C
from claimloom.operators import intake as I
from claimloom.operators.corpus_index import CorpusIndex, build
from claimloom.operators.vector_index import VectorIndex
from claimloom.plans.verify import verify
from claimloom.session import cut_lineage, run_folder
from claimloom.streaming.standing import StandingClaims
from workload import corpus, logs
from workload.base import TOKEN, table

_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, sf) -> CorpusIndex:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        docs = table(spark, sf, "documents").select("doc_id", "text")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
        first = docs.where(part < 8)
        other = docs.where(part == 0).withColumn("text", F.concat(F.lit("the and replaced "), F.reverse("text")))
        rest = docs.where((part == 0) | (part >= 8))
        _BUILT[key] = build(spark, run_folder(spark, "index"), [first, other, rest]).root
    return CorpusIndex(spark, _BUILT[key])


def corpus_index_terms(spark, sf):
    """Documents per term, off the block directory."""
    return _index(spark, sf).blocks().groupBy("term").agg(F.sum("n").alias("documents"))


def corpus_index_postings(spark, sf):
    """Postings per document, and the words they stand for."""
    lengths = _index(spark, sf).documents().select("doc_id", "length")
    return lengths.join(_index(spark, sf).held(), "doc_id", "left").na.fill(0, ["terms", "words"])


def keyword_leg_indexed(spark, sf):
    return _index(spark, sf).keyword_leg(logs._items(spark, sf)).withColumn("score", F.round("score", 4))


def token_search_indexed(spark, sf):
    return _index(spark, sf).search(["THE", "and"]).withColumn("score", F.round("score", 4))


def _verdicts(scores):
    return scores.select(
        "claim_id", "claim_text", "verdict", "decision_rule", "independent_origins", "evidence_count", "confidence_band",
        *[F.round(c, 6).alias(c) for c in ("support_score", "contradiction_score", "confidence_score")],
    )


def claim_verdicts_indexed(spark, sf):
    """The flagship with the tokens of the index."""
    found = verify(
        corpus.submissions(spark, sf), corpus.documents(spark, sf), corpus.sources(spark, sf), tokens=_index(spark, sf).tokens()
    )
    return _verdicts(found.claim_scores)


def standing_claims(spark, sf):
    """The claims of the flagship wait, the documents arrive in three parts, each of a file per core at most."""
    docs = corpus.documents(spark, sf)
    spoken = I.texts_by_origin(I.with_language(corpus.submissions(spark, sf)))
    waiting = StandingClaims(spark, run_folder(spark, "standing"), corpus.sources(spark, sf))
    waiting.register(C.claim_queries(C.extract_claims(spoken)), docs)
    landed, files = run_folder(spark, "landed"), spark.sparkContext.defaultParallelism
    for part in range(3):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part).coalesce(files).write.mode("append").parquet(landed)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(landed)
    waiting.start(arriving, run_folder(spark, "standing-offsets")).awaitTermination()
    return _verdicts(waiting.latest())


def vector_topk_indexed(spark, sf):
    """The ten nearest vectors of every vector whose id is divisible by 50, through cells filled in two additions."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    late = F.pmod(F.xxhash64("vec_id"), F.lit(10)) == 0
    index = VectorIndex(spark, run_folder(spark, "vectors")).build(vectors.where(~late))
    index.add(vectors.where(late), number=1)
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return index.topk(asked).withColumn("similarity", F.round("similarity", 6))


def _predictions(spark, sf):
    """The engine's own verdicts and confidences, each with the quality of a labelled document that speaks for the claim."""
    found = verify(corpus.submissions(spark, sf), corpus.documents(spark, sf), corpus.sources(spark, sf))
    read = found.evidence.select("claim_id", "doc_id").join(table(spark, sf, "labels"), "doc_id")
    scored = found.claim_scores.select("claim_id", "verdict", F.col("confidence_score").alias("score"))
    return cut_lineage(read.join(scored, "claim_id").select("verdict", "score", F.col("quality").cast("long").alias("label")))


def calibration_steps(spark, sf):
    steps = CA.isotonic(_predictions(spark, sf))
    return steps.select("low", "high", "n", F.round("rate", 6).alias("rate"))


def calibration_bins(spark, sf):
    bins = CA.reliability(_predictions(spark, sf))
    return bins.select("verdict", "bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_score", "rate", "gap")])


QUERIES = {f.__name__: f for f in (
    corpus_index_terms, corpus_index_postings, keyword_leg_indexed, token_search_indexed, claim_verdicts_indexed,
    vector_topk_indexed, standing_claims, calibration_steps, calibration_bins,
)}

_TERMS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM documents"

_PREDICTED = corpus._FLAG + """, told AS (SELECT claim_id, verdict, confidence_score FROM claim_scores),
  pr AS (SELECT verdict, round(confidence_score, 6) AS score, quality::BIGINT AS label FROM ev JOIN labels ON labels.doc_id = document_id JOIN told USING (claim_id))"""

ORACLES = {
    # the fit at a score is the greatest, over starts below it, of the least mean up to ends above it
    "calibration_steps": _PREDICTED + """, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM pr GROUP BY 1),
      c AS (SELECT score, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn, row_number() OVER w AS i FROM g WINDOW w AS (ORDER BY score)),
      m AS (SELECT a.i AS a, b.i AS b, (b.cp - a.cp + a.p)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM c a JOIN c b ON a.i <= b.i),
      lo AS (SELECT a, i, min(mean) AS least FROM m JOIN c ON c.i >= a AND b >= c.i GROUP BY a, i),
      f AS (SELECT i, round(max(least), 9) AS rate FROM lo WHERE a <= i GROUP BY i)
      SELECT min(score) AS low, max(score) AS high, sum(n)::BIGINT AS n, round(rate, 6) AS rate FROM f JOIN c USING (i) GROUP BY f.rate""",
    "calibration_bins": _PREDICTED + """ SELECT verdict, least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(sum(score::DECIMAL(20,6))::DOUBLE / count(*), 6) AS mean_score,
      round(sum(label)::DOUBLE / count(*), 6) AS rate, round(sum(label)::DOUBLE / count(*) - sum(score::DECIMAL(20,6))::DOUBLE / count(*), 6) AS gap FROM pr GROUP BY 1, 2""",
    "corpus_index_terms": f"SELECT term, count(DISTINCT doc_id) AS documents FROM ({_TERMS}) GROUP BY term",
    "corpus_index_postings": f"""SELECT d.doc_id, count(term) AS words, count(DISTINCT term) AS terms, count(term) AS length
      FROM documents d LEFT JOIN ({_TERMS}) t ON t.doc_id = d.doc_id GROUP BY 1""",
    "keyword_leg_indexed": logs.ORACLES["keyword_leg"],
    "token_search_indexed": f"""WITH {logs._TF} SELECT doc_id, round(sum(floor(tf * idf * 1e6 + 0.5)::BIGINT)::DOUBLE / 1e6, 4) AS score
      FROM tf JOIN idf USING (term) WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(*) = 2""",
    "vector_topk_indexed": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
      SELECT q.vec_id AS query_id, v.vec_id, round(round(list_cosine_similarity(v.v, q.v), 9), 6) AS similarity,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.v, q.v), 9) DESC, v.vec_id) AS rank
      FROM v q, v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""",
    "claim_verdicts_indexed": corpus.ORACLES["claim_verdicts_flagship"],
    "standing_claims": corpus.ORACLES["claim_verdicts_flagship"],
}
