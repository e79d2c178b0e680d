"""Claim x corpus relevance: candidates, gates, dedup, caps, audit.

The scoring rule gives a pair zero unless it shares a discriminating token (six letters or
more, or a number, and not a low-information word).  So pairs are found by an equality join on
discriminating tokens only, and each pair found is scored on the token lists its two rows
carry.  Nothing compares every claim with every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.functions import web as U
from claimloom.operators.skew import fits_broadcast, key_counts, salted_join
from claimloom.session import cut_lineage

# Claims up to this number, whose token lists take up to this many bytes, are sent to every task.
BROADCAST_CLAIMS = 20_000
BROADCAST_BYTES = 64 << 20
# Pairs of tokens of claims up to this number are sent to every task that cuts texts into theirs.
BROADCAST_PHRASES = 500_000
# Up to this many terms, and pairs, of all claims go to every task, where texts are cut down to them.
KNOWN = 20_000


def query_profiles(claims: DataFrame) -> DataFrame:
    """claims(claim_id, queries) -> what scoring needs: claim_id, queries(terms, size, pairs),
    all_terms, all_pairs, probes."""
    queries = F.transform(
        F.col("queries"),
        lambda q: F.struct(
            F.array_distinct(q["tokens"]).alias("terms"), X.bigrams(q["tokens"]).alias("pairs")
        ),
    )
    return (
        claims.select("claim_id", queries.alias("queries"))
        .withColumn("all_terms", F.array_distinct(F.flatten(F.col("queries.terms"))))
        .withColumn("all_pairs", F.array_distinct(F.flatten(F.col("queries.pairs"))))
        .withColumn("probes", F.filter("all_terms", X.is_discriminating))
    )


def text_profiles(texts: DataFrame, key: list[str], tokens: str = "tokens") -> DataFrame:
    """Distinct terms, distinct token pairs and probe terms of tokenised texts."""
    return texts.select(
        *key,
        F.array_distinct(tokens).alias("terms"),
        F.array_distinct(X.bigrams(F.col(tokens))).alias("pairs"),
    ).withColumn("probes", F.filter("terms", X.is_discriminating))


def known_only(texts: DataFrame, profiles: DataFrame, most: int = KNOWN) -> DataFrame:
    """Text profiles with only those terms and pairs that some claim has, in their order, where these are few.

    No other can be shared, so scores stay the same; but a text is searched once for them instead of once
    for every claim it meets.  They go out as literals, which tasks hash once and not per row."""
    held = {}
    for c in ("terms", "pairs"):
        items = X.unnest(profiles, [], F.col(f"all_{c}"), "item").distinct().limit(most + 1).collect()  # short words
        if len(items) > most:
            return texts
        held[c] = ", ".join("'" + r["item"].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in items)
    for c, listed in held.items():
        texts = texts.withColumn(c, F.expr(f"filter({c}, x -> x IN ({listed or 'NULL'}))"))
    return texts.withColumn("probes", F.filter("terms", X.is_discriminating))


def best_score(v: Column) -> Column:
    """Best score over the queries of a claim; v holds queries and the shared terms and pairs."""
    overlaps = F.transform(
        v["queries"],
        lambda q: F.struct(
            F.array_intersect(q["terms"], v["terms"]).alias("terms"),
            F.size(q["terms"]).alias("size"),
            F.size(F.filter(q["pairs"], lambda p: F.array_contains(v["pairs"], p))).alias("phrases"),
        ),
    )

    def score(o: Column) -> Column:
        rare = F.size(F.filter(o["terms"], lambda t: F.length(t) >= 6))
        numbers = F.size(F.filter(o["terms"], X.is_number_token))
        raw = (
            F.size(o["terms"]) / o["size"] * 0.6
            + F.least(F.lit(0.25), rare * 0.06)
            + F.least(F.lit(0.20), numbers * 0.10)
            + F.least(F.lit(0.25), o["phrases"] * 0.12)
        )
        eligible = F.exists(o["terms"], X.is_discriminating)
        return F.when(eligible, F.least(F.lit(1.0), raw)).otherwise(F.lit(0.0))

    return F.array_max(F.transform(overlaps, score))


def scored(met: DataFrame, min_score: float, probe: str | None = None) -> DataFrame:
    """Score rows holding a query profile (queries, all_terms, all_pairs) and a text profile
    (terms, pairs), keep those at or above min_score, drop the profiles.

    With `probe`, a row counts only if its probe is the first discriminating term shared, so a
    pair met several times is scored once.  Everything happens inside one generator: a filter
    on a computed column would make Spark compute the column twice.
    """

    def kept(t: Column) -> Column:
        shared = F.struct(
            F.col("queries").alias("queries"),
            t.alias("terms"),
            F.array_intersect("pairs", "all_pairs").alias("pairs"),
        )
        score = X.bind(shared, best_score)
        if probe is not None:
            first = F.get(F.filter(t, X.is_discriminating), F.lit(0))
            score = F.when(first == F.col(probe), score)
        return score

    scores = F.transform(F.array(F.array_intersect("terms", "all_terms")), kept)  # the short list is hashed
    floor = max(min_score, V.RELEVANCE_FLOOR)
    dropped = {"queries", "all_terms", "all_pairs", "terms", "pairs", probe}
    keep = [c for c in met.columns if c not in dropped]
    return X.unnest(met, keep, F.filter(scores, lambda s: s >= floor), "score")


def relevance(
    claims: DataFrame,
    docs: DataFrame,
    min_score: float = V.RELEVANCE_FLOOR,
    broadcast_claims: int = BROADCAST_CLAIMS,
) -> DataFrame:
    """(claim_id, doc_id, score) for every pair at or above min_score.

    claims(claim_id, queries) as built by ``claim_queries``; docs(doc_id, tokens).

    With few claims (by number and bytes) their profiles are broadcast and the corpus is read once with no shuffle at
    all.  A pair met through several shared probes is kept only at the first of them, which is
    decided on the row itself.  With many claims, probes meet postings in a salted shuffle
    join, pairs are made distinct, and the two profiles are joined back on, the claim's short one first.
    """
    profiles = query_profiles(claims)
    texts = known_only(text_profiles(docs, ["doc_id"]), profiles)
    listed = F.sum(F.length(F.to_json("queries")))
    if fits_broadcast(claims.select("claim_id"), broadcast_claims) and (claims.agg(listed).first()[0] or 0) <= BROADCAST_BYTES:
        index = X.unnest(profiles, ["claim_id"], F.col("probes"), "probe")
        lists = profiles.drop("probes")
        met = (
            X.unnest(texts, ["doc_id", "terms", "pairs"], F.col("probes"), "probe")
            .join(F.broadcast(index), "probe")
            .join(F.broadcast(lists), "claim_id")
        )
        pairs = scored(met, min_score, "probe")
    else:
        postings = X.unnest(texts, ["doc_id"], F.col("probes"), "probe")
        index = X.unnest(profiles, ["claim_id"], F.col("probes"), "probe")
        # the pairs are narrow rows read three times below: write them once
        found = cut_lineage(
            salted_join(postings, index, "probe", ["doc_id"]).select("claim_id", "doc_id").distinct()
        )
        with_claim = salted_join(found, profiles.drop("probes"), "claim_id", ["doc_id"])
        met = salted_join(with_claim, texts.drop("probes"), "doc_id", ["claim_id"], counts=key_counts(found, "doc_id"))
        pairs = scored(met, min_score)
    return pairs.select("claim_id", "doc_id", "score")


def phrase_bonus(claims: DataFrame, texts: DataFrame, broadcast_phrases: int = BROADCAST_PHRASES) -> DataFrame:
    """(claim_id, text_id, matches, bonus): query token pairs found in each text.

    claims(claim_id, tokens) and texts(text_id, tokens) meet on the pair itself; a pair that
    occurs twice in the query counts twice, in the text once.  Up to broadcast_phrases pairs of claims are sent to
    every task, so that of texts only sums leave one; more meet the texts' pairs in a salted join.
    """
    q = cut_lineage(
        X.unnest(claims, ["claim_id"], X.bigrams(F.col("tokens")), "pair")
        .groupBy("claim_id", "pair")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    d = X.unnest(texts, ["text_id"], F.array_distinct(X.bigrams(F.col("tokens"))), "pair")
    few = fits_broadcast(q, broadcast_phrases)
    return (
        (d.join(F.broadcast(q), "pair") if few else salted_join(d, q, "pair", ["text_id"]))
        .groupBy("claim_id", "text_id")
        .agg(F.sum("times").alias("matches"))
        .withColumn("bonus", F.least(F.lit(0.25), F.col("matches") * 0.12))
    )


def headline_gate(scores: DataFrame) -> DataFrame:
    """scores(title_score, body_score) -> rows whose title passes, with the combined score."""
    combined = F.least(F.lit(1.0), F.col("title_score") * 0.75 + F.col("body_score") * 0.25)
    return (
        scores.withColumn("score", combined)
        .where(F.col("title_score") >= V.TITLE_GATE)
        .where(F.col("score") > 0)
    )


def feed_candidates(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Gate docs(doc_id, title_tokens, body_tokens) by headline for each claim."""
    titles = relevance(claims, docs.select("doc_id", F.col("title_tokens").alias("tokens")), V.TITLE_GATE)
    passed = cut_lineage(titles.withColumnRenamed("score", "title_score"))
    # bodies of the documents whose titles passed only, scored for the claims they passed for
    bodies = docs.select("doc_id", F.col("body_tokens").alias("tokens")).join(
        passed.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    with_text = salted_join(passed, text_profiles(bodies, ["doc_id"]).drop("probes"), "doc_id", ["claim_id"])
    met = salted_join(with_text, query_profiles(claims).drop("probes"), "claim_id", ["doc_id"], counts=key_counts(passed, "claim_id"))
    scores = scored(met, V.RELEVANCE_FLOOR).select("claim_id", "doc_id", F.col("score").alias("body_score"))
    return headline_gate(passed.join(scores, ["claim_id", "doc_id"], "left").fillna({"body_score": 0.0}))


def union_candidates(*providers: tuple[str, DataFrame]) -> DataFrame:
    """Bag union of (name, candidates); the provider order breaks later ties."""
    out = None
    for number, (name, rows) in enumerate(providers):
        tagged = rows.withColumn("provider", F.lit(name)).withColumn("provider_no", F.lit(number))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def top_per_provider(candidates: DataFrame, k: int = V.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """Best k per (claim, provider).  Spark trims each task to k rows a group before shuffling."""
    order = Window.partitionBy("claim_id", "provider").orderBy(F.desc("score"), "doc_id")
    return candidates.withColumn("provider_rank", F.row_number().over(order)).where(
        F.col("provider_rank") <= k
    )


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """Highest-scoring candidate per (claim, URL key); the earlier one on a tie."""
    key = U.dedup_key(F.col("canonical_url"), F.col("url"))
    order = Window.partitionBy("claim_id", "dedup_key").orderBy(
        F.desc("score"), "provider_no", "provider_rank", "doc_id"
    )
    return (
        candidates.withColumn("dedup_key", key)
        .withColumn("_first", F.row_number().over(order))
        .where(F.col("_first") == 1)
        .drop("_first")
    )


def documents_to_read(
    candidates: DataFrame, k: int | None = V.DOCUMENTS_PER_CLAIM, min_score: float = V.CANDIDATE_MIN_SCORE
) -> DataFrame:
    """The first k candidates of each claim at or above the minimum score, all of them with k=None."""
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "provider_no", "doc_id")
    return (
        candidates.where(F.col("score") >= min_score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.lit(True) if k is None else F.col("rank") <= k)
    )


def query_audit(
    claims: DataFrame,
    candidates: DataFrame,
    errors: DataFrame | None = None,
    max_query_chars: int | None = 2000,
    max_error_chars: int | None = 255,
) -> DataFrame:
    """One row per (claim, query) with the number of candidates kept for the claim.

    errors(claim_id, error_no, error) are joined by '; ' per claim.  Texts are cut to the given numbers of
    characters, None cuts nothing; no more errors than can show are gathered.
    """

    def cut(c: Column, most: int | None) -> Column:
        return c if most is None else F.substring(c, 1, most)

    counts = candidates.groupBy("claim_id").agg(F.count(F.lit(1)).alias("result_count"))
    rows = (
        X.unnest(claims, ["claim_id", "language"], F.col("queries"), "q")
        .select(
            "claim_id", "language", "q.query_no", cut(F.col("q.query"), max_query_chars).alias("query_text")
        )
        .withColumn("provider", F.lit("RSS_CORPUS"))
        .join(counts, "claim_id", "left")
        .fillna({"result_count": 0})
    )
    if errors is None:
        return rows.withColumn("error", F.lit(None).cast("string"))
    if max_error_chars is not None:
        order = Window.partitionBy("claim_id").orderBy("error_no", "error")
        errors = errors.where(F.length("error") > 0).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_error_chars).drop("_n")
    joined = errors.groupBy("claim_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("error_no", "error"))), lambda e: e["error"]), "; ").alias("error")
    )
    return rows.join(joined, "claim_id", "left").withColumn("error", cut(F.col("error"), max_error_chars))


def run_totals(claims: DataFrame, candidates: DataFrame, errors: DataFrame | None = None, first: int = 5) -> DataFrame:
    """Per submission: claims searched, queries generated, documents found, and the first errors of
    errors(claim_id, error_no, error), by claim and number."""
    counts = candidates.groupBy("claim_id").agg(F.count(F.lit(1)).alias("found"))
    totals = (
        claims.select("submission_id", "claim_id", F.size("queries").alias("n_queries"))
        .join(counts, "claim_id", "left")
        .groupBy("submission_id")
        .agg(
            F.count(F.lit(1)).alias("claims_searched"),
            F.sum("n_queries").alias("queries_generated"),
            F.coalesce(F.sum("found"), F.lit(0)).alias("documents_found"),
        )
    )
    if errors is None:
        return totals
    order = Window.partitionBy("submission_id").orderBy("sequence", "error_no", "error")
    listed = errors.join(claims.select("submission_id", "claim_id", "sequence"), "claim_id")
    listed = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    found = listed.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct("n", "error"))).alias("e"))
    return totals.join(found.select("submission_id", F.col("e.error").alias("first_errors")), "submission_id", "left")
