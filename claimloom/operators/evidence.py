"""Documents to read -> passages -> labelled evidence with source and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import figures as G
from claimloom.functions import text as X
from claimloom.operators.corpus import cluster_key, origin_clusters
from claimloom.operators.retrieve import query_profiles, scored
from claimloom.operators.skew import fits_broadcast, salted_join

# Pairs below this number (claim and document id, score) are broadcast to the corpus scan.
BROADCAST_PAIRS = 500_000


def split_passages(text: Column, shortest: int | None = V.PASSAGE_MIN, longest: int | None = V.PASSAGE_MAX) -> Column:
    """Sentences of each line packed into passages of 60 to 600 characters.

    A sentence that does not fit starts the next passage, cut to `longest` characters; a passage that
    stays under `shortest` is dropped.  None for either: longer sentences stay whole, short passages are kept.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def emit(acc: Column) -> Column:
        return F.when(F.length(acc["cur"]) >= (1 if shortest is None else shortest), F.array_append(acc["out"], acc["cur"])).otherwise(
            acc["out"]
        )

    def add(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(sentence) + 1 <= V.PASSAGE_MAX
        return F.when(
            fits,
            F.struct(
                acc["out"].alias("out"),
                X.strip(F.concat(acc["cur"], F.lit(" "), sentence)).alias("cur"),
            ),
        ).otherwise(
            F.struct(emit(acc).alias("out"), (sentence if longest is None else F.substring(sentence, 1, longest)).alias("cur"))
        )

    def line(block: Column) -> Column:
        sentences = F.filter(
            F.transform(F.split(X.strip(block), X.SENTENCE_GAP, -1), X.strip), lambda s: s != ""
        )
        return F.aggregate(sentences, start, add, emit)

    return F.flatten(F.transform(F.split(text, "\n", -1), line))


def count_markers(text_lower: Column, words: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers occur: single words as whole words, phrases anywhere.

    `words` are the whitespace-separated words of the text, stripped of punctuation.
    """
    single = [m for m in markers if " " not in m]
    total = F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in single])))
    for phrase in markers:
        if " " in phrase:
            total = total + text_lower.contains(phrase).cast("int")
    return total


def marker_words(text_lower: Column) -> Column:
    return F.transform(
        F.split(text_lower, X.WS + "+", -1), lambda w: F.btrim(w, F.lit(V.MARKER_PUNCTUATION))
    )


def label_passages(pairs: DataFrame, period_mode: str = "reference") -> DataFrame:
    """Add relationship, directness, rationale, label_confidence to
    pairs(claim_text, claim_tokens, language, passage, passage_tokens).

    period_mode 'reference' takes years from the extracted numbers, which leave unscaled years
    out; 'years' takes them from the dates instead.
    """
    lower = F.lower(F.col("passage"))
    bangla = F.col("language") == "bn"

    def years(text: Column, values: Column) -> Column:
        if period_mode == "years":
            return F.transform(
                F.filter(G.extract_dates(text), lambda d: d["value"].isNotNull()),
                lambda d: d["value"].cast("double"),
            )
        return F.filter(values, lambda v: v.between(1900, 2100))

    prepared = (
        pairs.withColumn("_lower", lower)
        .withColumn("_words", marker_words(F.col("_lower")))
        .withColumn("_claim_set", F.array_distinct("claim_tokens"))
        .withColumn("_shared", F.array_intersect("_claim_set", "passage_tokens"))
        .withColumn(
            "_overlap",
            F.size("_shared") / F.greatest(F.size("_claim_set"), F.lit(1)),
        )
        .withColumn("_cv", G.figure_values(F.col("claim_text")))
        .withColumn("_pv", G.figure_values(F.col("passage")))
        .withColumn("_conflict", G.numeric_conflict(G.without_years(F.col("_cv")), G.without_years(F.col("_pv"))))
        .withColumn("_same", F.array_sort(F.array_intersect(G.without_years(F.col("_cv")), G.without_years(F.col("_pv")))))
        .withColumn("_cy", years(F.col("claim_text"), F.col("_cv")))
        .withColumn("_py", years(F.col("passage"), F.col("_pv")))
    )
    text, words = F.col("_lower"), F.col("_words")
    negations = count_markers(text, words, V.NEGATION_EN) + count_markers(text, words, V.NEGATION_BN)
    confirmations = F.when(bangla, count_markers(text, words, V.CONFIRMATION_BN)).otherwise(
        count_markers(text, words, V.CONFIRMATION_EN)
    )
    overlap = F.col("_overlap")
    direct = F.least(F.lit(1.0), overlap * 1.4)
    other_period = (F.size("_py") > 0) & (F.size(F.array_intersect("_cy", "_py")) == 0)
    conflict = F.col("_conflict")

    def label(name: str, confidence: float, rationale: Column | str, directness: Column = direct) -> Column:
        why = F.lit(rationale) if isinstance(rationale, str) else rationale
        return F.struct(
            F.lit(name).alias("relationship"),
            directness.alias("directness"),
            why.alias("rationale"),
            F.lit(confidence).alias("label_confidence"),
        )

    # Thresholds and rationale sentences.
    chosen = (
        F.when(
            conflict["conflict"] & (overlap >= 0.25) & ~other_period,
            label(
                "CONTRADICTS", 0.7,
                F.concat(
                    F.lit("Numeric disagreement: claim states "), G.general_format(conflict["claim_value"]),
                    F.lit(", source states "), G.general_format(conflict["passage_value"]),
                ),
            ),
        )
        .when(
            (negations >= 1) & (overlap >= 0.3),
            label("CONTRADICTS", 0.6, "Passage uses explicit denial or correction language about this claim."),
        )
        .when(
            (F.size("_same") > 0) & (overlap >= 0.25),
            label(
                "SUPPORTS", 0.7,
                F.concat(
                    F.lit("Passage reports the same figure ("),
                    F.array_join(F.transform("_same", G.general_format), ", "),
                    F.lit(") for the same subject."),
                ),
                F.greatest(direct, F.lit(0.7)),
            ),
        )
        .when(
            (overlap >= F.when(bangla, 0.38).otherwise(0.5)) & (confirmations >= 1),
            label("SUPPORTS", 0.6, "Passage reports the same facts in affirmative terms."),
        )
        .when(
            overlap >= F.when(bangla, 0.5).otherwise(0.65),
            label("SUPPORTS", 0.5, "Passage closely restates the claim."),
        )
        .otherwise(
            label("NEUTRAL", 0.4, "Passage is topically related but does not confirm or deny the claim.")
        )
    )
    return (
        prepared.withColumn("_label", chosen)
        .select(*pairs.columns, "_label.*")
        .withColumn("classifier", F.lit("lexical"))
    )


def passages_of(docs: DataFrame, shortest: int | None = V.PASSAGE_MIN, longest: int | None = V.PASSAGE_MAX) -> DataFrame:
    """docs(doc_id, body) -> (doc_id, passage_no, passage, passage_tokens)."""
    exploded = X.unnest(docs, ["doc_id"], split_passages(F.col("body"), shortest, longest), "passage", "passage_no")
    return X.with_tokens(exploded, "passage", "passage_tokens")


def evidence_for_claims(
    claims: DataFrame,
    chosen: DataFrame,
    docs: DataFrame,
    k: int | None = V.PASSAGES_PER_DOCUMENT,
    min_relevance: float = V.PASSAGE_MIN_RELEVANCE,
    period_mode: str = "reference",
    broadcast_pairs: int = BROADCAST_PAIRS,
    shortest: int | None = V.PASSAGE_MIN,
    longest: int | None = V.PASSAGE_MAX,
) -> DataFrame:
    """Best k passages of every chosen (claim_id, doc_id), labelled; all of them with k=None.

    claims as built by ``claim_queries``; chosen(claim_id, doc_id); docs(doc_id, body).  Passages are cut and tokenised once per document that was chosen at all.  Few pairs are broadcast to the corpus scan; many
    meet it in a salted join, since one popular document may be chosen by very many claims.
    """
    pairs = chosen.select("claim_id", "doc_id")
    profiles = query_profiles(claims).drop("probes")
    facts = claims.select("claim_id", "claim_text", "claim_tokens", "language")
    small = fits_broadcast(pairs, broadcast_pairs)
    wanted = pairs.select("doc_id").distinct()
    read = docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    passages = passages_of(read, shortest, longest)
    with_profile = passages.withColumn("terms", F.array_distinct("passage_tokens")).withColumn(
        "pairs", F.array_distinct(X.bigrams(F.col("passage_tokens")))
    )
    claim_side = profiles.join(facts, "claim_id")
    if small:
        met = with_profile.join(F.broadcast(pairs), "doc_id").join(claim_side, "claim_id")
    else:
        met = salted_join(pairs, with_profile, "doc_id", ["claim_id"]).join(claim_side, "claim_id")
    relevant = scored(met, min_relevance).withColumnRenamed("score", "relevance")
    order = Window.partitionBy("claim_id", "doc_id").orderBy(F.desc("relevance"), "passage_no")
    best = relevant.withColumn("_rank", F.row_number().over(order)).where(F.lit(True) if k is None else F.col("_rank") <= k).drop("_rank")
    labelled = label_passages(best, period_mode)
    display = Window.partitionBy("claim_id", "doc_id").orderBy(
        F.desc(F.col("relationship") == "CONTRADICTS"), F.desc("relevance"), "passage_no"
    )
    return (
        labelled.withColumn("display_rank", F.row_number().over(display))
        .withColumn("strength", F.col("relevance") * F.col("directness"))
        .withColumn(
            "evidence_id", F.concat_ws("|", "claim_id", F.col("doc_id").cast("string"), F.col("passage_no").cast("string"))
        )
        .drop("claim_tokens", "passage_tokens")
    )


def with_article(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Candidates(url, canonical_url, title, summary, published_at) with the article body where
    one was read, else the summary; rows with neither are dropped."""
    read = articles.select(
        "url",
        F.col("body").alias("_body"),
        F.col("title").alias("_title"),
        F.col("canonical_url").alias("_canonical"),
        F.col("published_at").alias("_published"),
    )
    joined = salted_join(candidates, read, "url", ["doc_id"], "left")
    empty = F.lit("")
    return (
        joined.withColumn("body", F.coalesce("_body", F.nullif(F.col("summary"), empty)))
        .withColumn("canonical_url", F.coalesce(F.nullif(F.col("_canonical"), empty), F.col("canonical_url")))
        .withColumn("title", F.coalesce(F.nullif(F.col("_title"), empty), F.col("title")))
        .withColumn("published_at", F.coalesce("published_at", "_published"))
        .where(F.col("body").isNotNull())
        .drop("_body", "_title", "_canonical", "_published", "summary")
    )


def with_origin(evidence: DataFrame, read_documents: DataFrame) -> DataFrame:
    """Evidence ⟕ origin cluster among the documents read for the same claim.

    read_documents(claim_id, doc_id, content_hash, title, canonical_url, url, published_at,
    created_at) holds at most six rows per claim, so each group is tiny.
    """
    clusters = origin_clusters(read_documents, ["claim_id"]).select("claim_id", "cluster_key")
    member = (
        read_documents.withColumn("cluster_key", cluster_key())
        .join(clusters, ["claim_id", "cluster_key"])
        .select("claim_id", "doc_id", F.col("cluster_key").alias("cluster_id"))
    )
    return evidence.join(member, ["claim_id", "doc_id"], "left")


def with_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence ⟕ sources(source, source_name, source_type, is_primary); unknown when missing."""
    dim = sources.select("source", "source_name", "source_type", "is_primary")
    if fits_broadcast(dim, 1_000_000):
        joined = evidence.join(F.broadcast(dim), "source", "left")
    else:
        joined = salted_join(evidence, dim, "source", ["evidence_id"], "left")
    return joined.fillna({"source_type": "UNKNOWN", "is_primary": False})


# ---- external labels -----------------------------------------------------------------

_LABEL_SCHEMA = "relationship string, directness string, reason string, confidence string"


def parse_labels(raw: Column) -> Column:
    """Struct(relationship, directness, reason, confidence) from a free-form reply, else null.

    The object runs from the first ``{`` to the last ``}``.  The schema is closed: a known
    relationship, a reason of at most 400 characters, and shares within 0..1 (0.5 if absent).
    """
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), _LABEL_SCHEMA)

    def share(name: str) -> Column:
        return F.when(found[name].isNull(), F.lit(0.5)).otherwise(found[name].try_cast("double"))

    directness, confidence = share("directness"), share("confidence")
    valid = (
        found["relationship"].isin(*V.RELATIONSHIPS)
        & found["reason"].isNotNull()
        & (F.length(found["reason"]) <= 400)
        & directness.between(0.0, 1.0)
        & confidence.between(0.0, 1.0)
    )
    return F.when(
        valid,
        F.struct(
            found["relationship"].alias("relationship"),
            directness.alias("directness"),
            found["reason"].alias("reason"),
            confidence.alias("confidence"),
        ),
    )


def override_labels(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the lexical label where labels(evidence_id, raw) holds a valid external one."""
    valid = (
        labels.withColumn("_new", parse_labels(F.col("raw")))
        .where(F.col("_new").isNotNull())
        .groupBy("evidence_id")
        .agg(F.min("_new").alias("_new"))
    )
    joined = evidence.join(valid, "evidence_id", "left")
    new = F.col("_new")
    return (
        joined.withColumn("relationship", F.coalesce(new["relationship"], F.col("relationship")))
        .withColumn("directness", F.coalesce(new["directness"], F.col("directness")))
        .withColumn("rationale", F.coalesce(new["reason"], F.col("rationale")))
        .withColumn("label_confidence", F.coalesce(new["confidence"], F.col("label_confidence")))
        .withColumn("classifier", F.when(new.isNotNull(), "llm").otherwise(F.col("classifier")))
        .drop("_new")
    )
