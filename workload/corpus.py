"""Submission, claim, corpus, retrieval and evidence queries over documents, benchmark, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.functions import web as U
from claimloom.operators import claims as C
from claimloom.operators import corpus as K
from claimloom.operators import declared as D
from claimloom.operators import evidence as E
from claimloom.operators import intake as I
from claimloom.operators import links as N
from claimloom.operators import report as P
from claimloom.operators import retrieve as R
from claimloom.operators import scores as S
from claimloom.plans.verify import verify
from claimloom.session import cut_lineage
from claimloom.sources import registry
from workload.base import (
    quoted,
    sql_bigrams,
    sql_case,
    sql_discriminating,
    sql_is_number,
    sql_queries,
    sql_sentences,
    sql_tokens,
    table,
)

_TYPES = list(V.SOURCE_TYPES)
_DAY0 = "2024-01-01"


def documents(spark, sf) -> DataFrame:
    """The corpus: every document with URL, title (first sentence), date and source."""
    d = table(spark, sf, "documents")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string"))
    published = F.when(F.col("doc_id") % 5 != 0, F.date_add(F.lit(_DAY0).cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp"))
    return d.select(
        "doc_id", F.col("text").alias("body"), "source", "lang", url.alias("url"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"),
        published.alias("published_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"),
    )


def sources(spark, sf) -> DataFrame:
    """One row per document source; types and primary flags follow from its number."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), n % len(_TYPES) + 1)
    domain = F.when(n % 4 == 0, F.concat("source", F.lit(".who.int"))).otherwise(F.concat("source", F.lit(".example.org")))
    base = (
        table(spark, sf, "documents").select("source").distinct()
        .select("source", F.upper("source").alias("source_name"), kind.alias("source_type"), domain.alias("domain"))
    )
    flags = K.primary_flags(base.select("domain").distinct(), registry.primary_sources(spark))
    return base.join(flags, "domain")


SOURCES = f"""sources AS (SELECT DISTINCT source, upper(source) AS source_name,
  ([{quoted(_TYPES)}])[regexp_extract(source, '(\\d+)$', 1)::INT % {len(_TYPES)} + 1] AS source_type,
  regexp_extract(source, '(\\d+)$', 1)::INT % 4 = 0 AS is_primary,
  source||CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT % 4 = 0 THEN '.who.int' ELSE '.example.org' END AS domain FROM documents)"""


def submissions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("submission_id"), "text")


def claims(spark, sf) -> DataFrame:
    return C.claim_queries(C.extract_claims(I.texts_by_origin(I.with_language(submissions(spark, sf))), parse=False))


def tokened(spark, sf) -> DataFrame:
    return X.with_tokens(documents(spark, sf).select("doc_id", "body"), "body", "tokens").drop("body")


# Sentences of benchmark items are claims; the same rules as in claim extraction.
CLAIMS = f"""
sent AS (SELECT item_id, unnest(range(len(s))) AS sentence_no, unnest(s) AS claim_text
         FROM (SELECT item_id, ({sql_sentences('text')})[1:25] AS s FROM benchmark)),
claims AS (SELECT item_id||'#'||(row_number() OVER (PARTITION BY item_id ORDER BY sentence_no) - 1) AS claim_id, item_id AS submission_id,
         row_number() OVER (PARTITION BY item_id ORDER BY sentence_no) - 1 AS sequence, sentence_no, claim_text, {sql_tokens('claim_text')} AS claim_tokens
         FROM sent WHERE length(claim_text) >= 15),
queries AS (SELECT claim_id, query_no, query, {sql_tokens('query')} AS tokens FROM (
         SELECT claim_id, unnest(range(len(qs))) AS query_no, unnest(qs) AS query FROM (
         SELECT claim_id, {sql_queries('claim_text', 'claim_tokens')} AS qs FROM claims))),
qterms AS (SELECT claim_id, query_no, t, len(list_distinct(tokens)) AS size FROM (
         SELECT claim_id, query_no, tokens, unnest(list_distinct(tokens)) AS t FROM queries)),
qpairs AS (SELECT claim_id, query_no, p, count(*) AS times FROM (
         SELECT claim_id, query_no, unnest({sql_bigrams('tokens')}) AS p FROM queries) GROUP BY ALL)
"""


def sql_relevance(name: str, texts: str, key: str, among: str = "") -> str:
    """CTEs ending in `name`(claim_id, key, score): texts holds key columns and tokens; with
    `among`, pairs are joined to rows (claim_id, doc_id) of that CTE."""
    first = key.split(",")[0].strip()
    extra = f" JOIN {among} a ON a.claim_id = q.claim_id AND a.doc_id = d.{first}" if among else ""
    dkeys = ", ".join(f"d.{k.strip()}" for k in key.split(","))
    on = " AND ".join(f"o.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    okeys = ", ".join(f"o.{k.strip()}" for k in key.split(","))
    return f"""
{name}_t AS (SELECT {key}, unnest(list_distinct(tokens)) AS t FROM {texts}),
{name}_p AS (SELECT DISTINCT {key}, unnest({sql_bigrams('tokens')}) AS p FROM {texts}),
{name}_o AS (SELECT q.claim_id, q.query_no, {dkeys}, any_value(q.size) AS size, count(*) AS n,
    count(*) FILTER (length(q.t) >= 6) AS rare, count(*) FILTER ({sql_is_number('q.t')}) AS nums,
    count(*) FILTER ({sql_discriminating('q.t')}) AS disc
    FROM qterms q JOIN {name}_t d ON q.t = d.t{extra} GROUP BY q.claim_id, q.query_no, {dkeys}
    HAVING count(*) FILTER ({sql_discriminating('q.t')}) > 0),
{name}_b AS (SELECT q.claim_id, q.query_no, {dkeys}, sum(q.times) AS phrases
    FROM qpairs q JOIN {name}_p d ON q.p = d.p{extra} GROUP BY q.claim_id, q.query_no, {dkeys}),
{name} AS (SELECT * FROM (SELECT o.claim_id, {okeys}, max(least(1.0::DOUBLE, n::DOUBLE / size::DOUBLE * 0.6::DOUBLE
      + least(0.25::DOUBLE, rare * 0.06::DOUBLE) + least(0.2::DOUBLE, nums * 0.1::DOUBLE)
      + least(0.25::DOUBLE, coalesce(phrases, 0)::DOUBLE * 0.12::DOUBLE))) AS score
    FROM {name}_o o LEFT JOIN {name}_b b ON o.claim_id = b.claim_id AND o.query_no = b.query_no AND {on}
    GROUP BY o.claim_id, {okeys}) WHERE score >= 0.08)"""


_DOCS = f"docs AS (SELECT doc_id, text AS body, {sql_tokens('text')} AS tokens FROM documents)"
_REL = f"WITH {CLAIMS}, {_DOCS}, {sql_relevance('rel', 'docs', 'doc_id')}"
_TOP = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS rank FROM rel WHERE score >= 0.12),
chosen AS (SELECT claim_id, doc_id, score, rank FROM ranked WHERE rank <= 6)"""

# ---- intake and claims ---------------------------------------------------------------


def submission_intake(spark, sf):
    """conversations as submissions: some carry a URL, some media, some break a rule."""
    c = table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 8
    raw = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("submission_id"),
        F.when(k < 4, F.when(k == 3, F.repeat("text", (F.floor(50_000 / F.length("text")) + 1).cast("int"))).otherwise(F.col("text"))).alias("text"),
        F.when(k == 2, F.repeat(F.lit("t"), 501)).alias("title"),
        F.when(k == 4, F.concat(F.lit("https://m.facebook.com/"), F.col("conv_id").cast("string")))
        .when(k == 5, F.concat(F.lit("https://news.example.org/"), F.col("turn").cast("string"))).alias("url"),
        F.when((k < 4) | (F.col("turn") % 3 > 0), F.col("text")).alias("caption"),
        F.when(k == 6, "IMAGE").when((k == 7) & (F.col("turn") < 5), "VIDEO").alias("media_kind"),
        (F.col("conv_id") % 2 == 0).alias("is_screenshot"),
    )
    accepted, rejected = I.intake(raw)
    return accepted.select("submission_id", "content_type", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("submission_id", F.lit(None).cast("string").alias("content_type"), "reject_reason")
    )


def _spoken(spark, sf) -> DataFrame:
    """conversations: one submission per turn, the role deciding whose voice the text is."""
    c = table(spark, sf, "conversations")
    role = F.col("role")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("submission_id"),
        F.when(role == "user", F.col("text")).alias("text"),
        F.when((role == "system") | (F.col("turn") % 3 == 0), F.concat(F.lit("Caption says: "), "text")).alias("caption"),
        F.when(role == "assistant", F.col("text")).alias("article"),
    )


def texts_by_origin(spark, sf):
    return I.texts_by_origin(_spoken(spark, sf)).select("submission_id", "origin_no", "origin", "text")


def claims_extract(spark, sf):
    found = C.extract_claims(I.texts_by_origin(I.with_language(_spoken(spark, sf))), parse=False)
    return found.select("submission_id", "sequence", "origin", "language", "sentence_no", "claim_text", "claim_type", F.round("importance", 6).alias("importance"))


def claims_extract_whole(spark, sf):
    """Claims of all sentences of every document, no text cut short."""
    spoken = documents(spark, sf).select(F.col("doc_id").alias("submission_id"), F.lit(0).alias("origin_no"), F.lit("USER_TEXT").alias("origin"), F.col("body").alias("text"))
    found = C.extract_claims(spoken, max_claims=None, parse=False)
    return found.select("submission_id", "sequence", "sentence_no", "claim_text")


def claims_parsed(spark, sf):
    """Claims of benchmark items with all parsed parts counted."""
    found = C.extract_claims(I.texts_by_origin(I.with_language(submissions(spark, sf))))
    return found.select("claim_id", *[F.size(c).alias(f"n_{c}") for c in ("money", "percentages", "numbers", "dates", "entities")])


# ---- corpus --------------------------------------------------------------------------


def article_extract(spark, sf):
    a = K.articles(table(spark, sf, "pages"))
    return a.select("page_id", "title", "canonical_url", "body", "content_hash", "injection_detected")


def article_extract_whole(spark, sf):
    """Articles of any length: ten pages' bodies in one, so that the usual cap would cut."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("html", "(?i)</?(html|body)[^>]*>", "").alias("html"))
    many = pages.groupBy(F.floor(F.col("page_id") / 10).alias("page_id")).agg(
        F.min("url").alias("url"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda p: p["html"]), "\n").alias("html")
    )
    a = K.articles(many, max_chars=None)
    return a.select("page_id", F.length("body").alias("n_chars"), "content_hash")


def _linked_pages(spark, sf) -> DataFrame:
    """pages with their headline also linked, as on a publisher's result page."""
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    site = U.host(F.col("url"))

    def a(href, text):
        return F.concat(F.lit('<a class="r" href="'), href, F.lit('"><b>'), text, F.lit("</b></a>"))

    pid = F.col("page_id").cast("string")
    extra = F.concat(
        a(F.concat(F.lit("/story/"), pid), title), a(F.concat(F.lit("/story/"), pid), title), a(F.concat(F.lit("/tag/"), pid), title),
        a(F.concat(F.lit("https://other.invalid/"), pid), title), a(F.concat(F.lit("story/b"), pid), F.concat(title, F.lit(" again"))),
    )
    return p.select("page_id", site.alias("site_domain"), F.concat("html", extra).alias("html"))


def link_extract(spark, sf):
    return K.page_links(_linked_pages(spark, sf))


def origin_clusters(spark, sf):
    docs = documents(spark, sf).withColumn("content_hash", X.body_hash(F.col("body")))
    return K.origin_clusters(docs).select("cluster_key", "method", "member_count", "representative_id", "similarity")


def origin_clusters_by_title(spark, sf):
    """Clustering when no body was kept: the title decides."""
    docs = documents(spark, sf).withColumn("content_hash", F.lit(None).cast("string"))
    return K.origin_clusters(docs).select("method", "member_count", "representative_id")


def _linked(spark, sf) -> DataFrame:
    """Documents with the keys of every kind of link; every tenth says where it was first printed."""
    first = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("https://wire.example.org/"), F.floor(F.col("doc_id") / 30).cast("string"), F.lit("/")))
    docs = documents(spark, sf).withColumns({"canonical_url": first, "content_hash": X.body_hash(F.col("body"))})
    return docs.withColumn("simhash", D.simhash(D.plain_tokens(F.col("body"))))


def origin_links_assignment(spark, sf):
    return N.linked_origins(_linked(spark, sf))


def origin_links_clusters(spark, sf):
    return N.linked_clusters(_linked(spark, sf))


def cluster_assignment(spark, sf):
    docs = documents(spark, sf).withColumn("content_hash", X.body_hash(F.col("body")))
    return K.cluster_assignment(docs)


def document_upsert(spark, sf):
    d = documents(spark, sf)
    key = F.concat(F.lit("https://x.example.org/"), (F.col("doc_id") % 100).cast("string"))
    oldest = d.groupBy(key.alias("key")).agg(F.min_by(F.struct("url", "title", "body"), "doc_id").alias("d"))
    # the store as an earlier run left it
    none = d.limit(0).select(F.lit("").alias("key"), "url", "title", F.col("body").alias("excerpt"), F.lit("").alias("content_hash"))
    stored = K.upsert_documents(none, oldest.select(
        F.lit(0).cast("long").alias("arrival_no"), F.col("key").alias("canonical_url"), "d.url", "d.title", "d.body"
    ))
    new = d.select(
        F.col("doc_id").alias("arrival_no"), F.concat(key, F.lit("/")).alias("url"), F.lit(None).cast("string").alias("canonical_url"), "title", "body"
    )
    return K.upsert_documents(stored, new)


def source_upsert(spark, sf):
    d = table(spark, sf, "documents")
    stored = table(spark, sf, "supplier").select(
        F.concat(F.lit("src"), (F.col("s_suppkey") * 2).cast("string")).alias("domain"), F.col("s_name").alias("name"), F.lit("UNKNOWN").alias("source_type")
    )
    kind = F.when(F.col("doc_id") % 4 == 0, "UNKNOWN").otherwise(F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("doc_id") % 11 + 1).cast("int")))
    new = d.select(F.col("doc_id").alias("arrival_no"), F.col("source").alias("domain"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).alias("name"), kind.alias("source_type"))
    return K.upsert_sources(stored, new)


def primary_suffix_join(spark, sf):
    """Hosts of pages below or beside registered domains."""
    p = table(spark, sf, "pages")
    names = [r[1] for r in V.PRIMARY_SOURCES]
    reg = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % len(names) + 1).cast("int"))
    host = U.host(F.col("url"))
    k = F.col("page_id") % 4
    domain = F.when(k == 0, reg).when(k == 1, F.concat(host, F.lit("."), reg)).when(k == 2, F.concat(F.lit("not"), reg)).otherwise(host)
    return K.primary_flags(p.select(domain.alias("domain")).distinct(), registry.primary_sources(spark))


def _feeds(spark, sf) -> DataFrame:
    """A feed registry read off suppliers; every seventh entry misses its URL."""
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey")
    return s.select(
        n.alias("feed_no"), F.col("s_name").alias("name"),
        F.when(n % 7 != 0, F.concat(F.lit("https://f"), n.cast("string"), F.lit(".example.org/rss"))).alias("url"),
        F.concat(F.lit("f"), n.cast("string"), F.lit(".example.org")).alias("domain"),
        F.when(n % 3 == 0, "bn").when(n % 3 == 1, "fr").alias("language"), F.lit(None).cast("string").alias("country"),
        F.when(n % 2 == 0, "world").alias("category"),
        F.when(n % 5 == 0, "NOT_A_TYPE").when(n % 5 == 1, "NEWS_AGENCY").alias("source_type"),
        F.when(n % 11 == 0, F.lit(False)).alias("enabled"),
    )


def feed_registry(spark, sf):
    return registry.feeds(_feeds(spark, sf))


def feed_priority(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("lang").alias("language")).distinct()
    return K.feed_priority(registry.feeds(_feeds(spark, sf)), langs)


# ---- retrieval -----------------------------------------------------------------------


def relevance_score(spark, sf):
    return R.relevance(claims(spark, sf), tokened(spark, sf)).withColumn("score", F.round("score", 6))


def relevance_score_shuffled(spark, sf):
    """The same pairs by the path taken when claims are too many to broadcast."""
    return R.relevance(claims(spark, sf), tokened(spark, sf), broadcast_claims=0).withColumn("score", F.round("score", 6))


def phrase_bonus(spark, sf):
    c = claims(spark, sf).select("claim_id", F.col("claim_tokens").alias("tokens"))
    d = tokened(spark, sf).withColumnRenamed("doc_id", "text_id")
    return R.phrase_bonus(c, d).withColumn("bonus", F.round("bonus", 6))


def _gated(spark, sf) -> DataFrame:
    d = documents(spark, sf)
    t = X.with_tokens(X.with_tokens(d.select("doc_id", "title", "body"), "title", "title_tokens"), "body", "body_tokens")
    return R.feed_candidates(claims(spark, sf), t.select("doc_id", "title_tokens", "body_tokens"))


def headline_gate(spark, sf):
    return _gated(spark, sf).select("claim_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("title_score", "body_score", "score")])


def _candidates(spark, sf) -> DataFrame:
    # both providers read the scores, so they are written once
    scores = cut_lineage(R.relevance(claims(spark, sf), tokened(spark, sf), min_score=V.CANDIDATE_MIN_SCORE))
    facts = documents(spark, sf).select("doc_id", "source", F.concat(F.lit("https://x.example.org/"), (F.col("doc_id") % 50).cast("string")).alias("url"), "canonical_url")
    second = scores.withColumn("score", F.col("score") * 0.9)
    both = R.union_candidates(("RSS_CORPUS", scores), ("DIRECT_URL", second))
    return both.join(facts, "doc_id")


def provider_union(spark, sf):
    return _candidates(spark, sf).groupBy("provider", "claim_id").agg(F.count(F.lit(1)).alias("n"))


def top_candidates(spark, sf):
    return R.top_per_provider(_candidates(spark, sf), 10).select("claim_id", "provider", "doc_id", "provider_rank")


def candidate_dedup(spark, sf):
    top = R.top_per_provider(_candidates(spark, sf), 40)
    return R.dedup_candidates(top).select("claim_id", "dedup_key", "doc_id", "provider", F.round("score", 6).alias("score"))


def documents_read(spark, sf):
    scores = R.relevance(claims(spark, sf), tokened(spark, sf)).withColumn("provider_no", F.lit(0))
    return R.documents_to_read(scores).select("claim_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def query_audit(spark, sf):
    c = claims(spark, sf)
    scores = R.relevance(c, tokened(spark, sf), min_score=V.CANDIDATE_MIN_SCORE)
    errors = c.where(F.col("sequence") == 0).select("claim_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("error_no")).withColumn("error", F.concat(F.lit("DIRECT_URL:timeout"), F.col("error_no").cast("string")))
    return R.query_audit(c, scores, errors).drop("language")


def run_totals(spark, sf):
    c = claims(spark, sf)
    errors = c.select("claim_id", "sequence", F.explode(F.array(F.lit(1), F.lit(2))).alias("error_no"))
    errors = errors.select("claim_id", "error_no", F.concat(F.lit("timeout "), F.col("sequence").cast("string"), F.lit("."), F.col("error_no").cast("string")).alias("error"))
    out = R.run_totals(c, R.relevance(c, tokened(spark, sf), min_score=V.CANDIDATE_MIN_SCORE), errors)
    return out.withColumn("first_errors", F.array_join("first_errors", "; "))


# ---- evidence ------------------------------------------------------------------------


def split_passages(spark, sf):
    docs = documents(spark, sf)
    return X.unnest(docs, ["doc_id"], E.split_passages(F.col("body")), "passage", "passage_no")


def _result(spark, sf):
    return verify(submissions(spark, sf), documents(spark, sf), sources(spark, sf))


def evidence_for_claims(spark, sf):
    ev = _result(spark, sf).evidence
    return ev.select(
        "claim_id", "doc_id", "passage_no", "passage", "relationship", "display_rank", "source_type", "is_primary",
        F.round("relevance", 6).alias("relevance"), F.round("directness", 6).alias("directness"),
        "rationale", F.col("cluster_id").isNotNull().alias("clustered"),
    )


def claim_verdicts_flagship(spark, sf):
    """Verdict of every claim of every submission against the whole corpus."""
    s = _result(spark, sf).claim_scores
    return s.select(
        "claim_id", "claim_text", "verdict", "decision_rule", "independent_origins", "evidence_count", "confidence_band",
        *[F.round(c, 6).alias(c) for c in ("support_score", "contradiction_score", "confidence_score")],
    )


def submission_verdicts(spark, sf):
    o = _result(spark, sf).overall
    return o.select("verification_id", "overall_verdict", "decision_rule", "claim_count", "confidence_band", F.round("confidence_score", 6).alias("confidence_score"))


def report(spark, sf):
    """Per claim: how the nested evidence of its report splits."""
    r = _result(spark, sf)
    ev = r.evidence.select(
        "claim_id", "display_rank", "doc_id", "relationship", F.col("passage").alias("evidence_text"), "relevance", "cluster_id",
        F.col("source_name").alias("document_title"), F.col("source").alias("document_url"),
    )
    rep = P.report(r.claim_scores, ev)
    return rep.select(
        "claim_id", "sequence", P.shown_verdict(F.col("verdict")).alias("verdict"),
        F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"),
        F.array_join(F.transform("supporting", lambda e: e["doc_id"].cast("string")), ",").alias("supporting_docs"),
    ).fillna({"supporting_docs": ""}).withColumn("n_evidence", F.greatest("n_evidence", F.lit(0)))


QUERIES = {f.__name__: f for f in (
    submission_intake, texts_by_origin, claims_extract, claims_extract_whole, claims_parsed, article_extract, article_extract_whole, link_extract, origin_clusters,
    origin_clusters_by_title, cluster_assignment, document_upsert, source_upsert, primary_suffix_join, feed_registry,
    feed_priority, relevance_score, relevance_score_shuffled, phrase_bonus, headline_gate, provider_union, top_candidates,
    candidate_dedup, documents_read, query_audit, run_totals, split_passages, evidence_for_claims,
    claim_verdicts_flagship, submission_verdicts, report, origin_links_assignment, origin_links_clusters,
)}

_WSP = "' '||chr(9)||chr(10)||chr(13)"
_PASSAGES = f"""
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(body, chr(10)) AS ls FROM pdocs)),
folded AS (SELECT doc_id, line_no, list_reduce(
    list_transform(list_filter(list_transform(string_split(regexp_replace(trim(line, {_WSP}), '([.!?।])\\s+', '\\1'||chr(2), 'g'), chr(2)), lambda x: trim(x, {_WSP})), lambda x: x <> ''),
      lambda x: {{'out': []::VARCHAR[], 'cur': x}}),
    lambda acc, x: CASE WHEN length(acc.cur) + length(x.cur) + 1 <= 600 THEN {{'out': acc.out, 'cur': trim(acc.cur||' '||x.cur)}}
      ELSE {{'out': CASE WHEN length(acc.cur) >= 60 THEN list_append(acc.out, acc.cur) ELSE acc.out END, 'cur': left(x.cur, 600)}} END,
    {{'out': []::VARCHAR[], 'cur': ''}}) AS f FROM lines WHERE trim(line, {_WSP}) <> ''),
cut AS (SELECT doc_id, line_no, unnest(range(len(o))) AS n, unnest(o) AS passage FROM (
    SELECT doc_id, line_no, CASE WHEN length(f.cur) >= 60 THEN list_append(f.out, f.cur) ELSE f.out END AS o FROM folded)),
passages AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, n) - 1 AS passage_no, passage FROM cut)"""

_ALL_MARKERS = V.NEGATION_EN + V.NEGATION_BN


def _sql_markers(markers) -> str:
    singles = quoted(m for m in markers if " " not in m)
    phrases = " + ".join(f"contains(lower(passage), '{m}')::INT" for m in markers if " " in m)
    words = "list_transform(string_split_regex(lower(passage), '\\s+'), lambda w: trim(w, ' .,;:!?()[]{}\"''‘’“”।–—-'))"
    return f"(len(list_distinct(list_filter({words}, lambda w: w IN ({singles})))) + {phrases})"


_EVIDENCE = f"""{_REL}, {_TOP},
pdocs AS (SELECT doc_id, text AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM chosen)), {_PASSAGES},
ptoks AS (SELECT doc_id, passage_no, passage, {sql_tokens('passage')} AS tokens FROM passages),
{sql_relevance('prel', 'ptoks', 'doc_id, passage_no', 'chosen')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY score DESC, passage_no) AS r FROM prel WHERE score >= 0.15) WHERE r <= 3),
pairs AS (SELECT b.claim_id, b.doc_id, b.passage_no, b.score AS relevance, passage, claim_text,
    len(list_intersect(claim_tokens, tokens))::DOUBLE / greatest(len(list_distinct(claim_tokens)), 1)::DOUBLE AS overlap,
    {_sql_markers(_ALL_MARKERS)} AS negations,
    {_sql_markers(V.CONFIRMATION_EN)} AS confirmations,
    list_intersect(list_transform(regexp_extract_all(claim_text, '\\b\\d+\\b'), lambda x: x::DOUBLE), list_transform(regexp_extract_all(passage, '\\b\\d+\\b'), lambda x: x::DOUBLE)) AS same
  FROM best b JOIN claims USING (claim_id) JOIN ptoks USING (doc_id, passage_no)),
labelled AS (SELECT *, CASE WHEN negations >= 1 AND overlap >= 0.3 THEN 'CONTRADICTS' WHEN len(same) > 0 AND overlap >= 0.25 THEN 'SUPPORTS'
    WHEN overlap >= 0.5 AND confirmations >= 1 THEN 'SUPPORTS' WHEN overlap >= 0.65 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS relationship,
   CASE WHEN negations >= 1 AND overlap >= 0.3 THEN 'Passage uses explicit denial or correction language about this claim.'
    WHEN len(same) > 0 AND overlap >= 0.25 THEN 'figure'
    WHEN overlap >= 0.5 AND confirmations >= 1 THEN 'Passage reports the same facts in affirmative terms.' WHEN overlap >= 0.65 THEN 'Passage closely restates the claim.'
    ELSE 'Passage is topically related but does not confirm or deny the claim.' END AS rationale,
   least(1.0::DOUBLE, overlap * 1.4::DOUBLE) AS directness FROM pairs),
{SOURCES},
clustered AS (SELECT claim_id, doc_id, 'hash:'||sha256(text) AS cluster_id, count(*) OVER (PARTITION BY claim_id, sha256(text)) AS members
   FROM chosen JOIN documents USING (doc_id)),
evidence AS (SELECT l.*, s.source, source_name, source_type, is_primary, CASE WHEN members >= 2 THEN cluster_id END AS cluster_id,
   row_number() OVER (PARTITION BY l.claim_id, l.doc_id ORDER BY (relationship = 'CONTRADICTS')::INT DESC, relevance DESC, passage_no) AS display_rank,
   l.claim_id||'|'||l.doc_id||'|'||passage_no AS evidence_id
   FROM labelled l JOIN documents d ON d.doc_id = l.doc_id JOIN sources s ON s.source = d.source JOIN clustered c ON c.claim_id = l.claim_id AND c.doc_id = l.doc_id)"""


def _flagship_scores() -> str:
    from workload.scoring import EVIDENCE as SCORING

    body = SCORING[SCORING.index("weighted AS"):]
    head = _EVIDENCE.replace("claims AS (SELECT item_id||", "claims0 AS (SELECT item_id||").replace("FROM claims)", "FROM claims0)").replace("JOIN claims USING", "JOIN claims0 USING")
    return head + f""", ev AS (SELECT claim_id, evidence_id, doc_id AS document_id, 0 AS source_id, cluster_id, relationship, relevance, source_type, is_primary,
        1.0::DOUBLE AS temporal_factor, 1.0::DOUBLE AS directness, NULL::VARCHAR AS penalty_type FROM evidence),
      traits AS (SELECT claim_id, submission_id AS verification_id, sequence, claim_text, sentence_no,
        {_SQL_TYPE} AS claim_type FROM claims0),
      claims AS (SELECT *, greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN sentence_no = 0 THEN 0.25::DOUBLE WHEN sentence_no < 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
        - CASE WHEN claim_type IN ('OPINION', 'PREDICTION') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)) AS importance, FALSE AS is_satirical FROM traits),
      """ + body


_SQL_TYPE = """CASE WHEN regexp_matches(claim_text, '(?i)\\b(i think|i believe|in my opinion|arguably|should|ought to|best|worst|beautiful|ugly|terrible|wonderful|deserve|hopefully|probably will)\\b') THEN 'OPINION'
  WHEN regexp_matches(claim_text, '(?i)\\b(will|going to|expected to|forecast|predicted|by \\d{4}|next year|soon)\\b') THEN 'PREDICTION'
  WHEN regexp_matches(claim_text, '"[^"]{10,}"') THEN 'QUOTE'
  WHEN regexp_matches(claim_text, '(?i)\\b(said|says|according to|reported|claimed|stated|announced|told)\\b') THEN 'ATTRIBUTION'
  WHEN regexp_matches(claim_text, '(?i)\\b(because|due to|caused by|led to|resulted in)\\b') THEN 'CAUSAL' ELSE 'OTHER' END"""

_FLAG = _flagship_scores()
from workload.scoring import OVERALL as _OVERALL  # noqa: E402

_FLAG_OVERALL = _FLAG + "," + _OVERALL.replace("SELECT c_custkey AS verification_id, c_nationkey % 4 = 0 AS degraded FROM customer", "SELECT item_id AS verification_id, FALSE AS degraded FROM benchmark")

_BASE_DOCS = f"""bdocs AS (SELECT doc_id, text AS body, source, regexp_extract(text, '^[^.!?\\n]*') AS title, 'https://'||source||'.example.org/'||doc_id AS url,
  CASE WHEN doc_id % 5 <> 0 THEN DATE '{_DAY0}' + (doc_id % 365)::INT END AS published_at, doc_id AS created_no FROM documents)"""

_SPOKEN = """spoken AS (SELECT conv_id||'-'||turn AS submission_id, CASE WHEN role = 'user' THEN text END AS t0,
  CASE WHEN role = 'system' OR turn % 3 = 0 THEN 'Caption says: '||text END AS t1, CASE WHEN role = 'assistant' THEN text END AS t2 FROM conversations),
voices AS (SELECT submission_id, 0 AS origin_no, 'USER_TEXT' AS origin, t0 AS text FROM spoken UNION ALL SELECT submission_id, 1, 'USER_CAPTION', t1 FROM spoken
  UNION ALL SELECT submission_id, 2, 'ARTICLE_TEXT', t2 FROM spoken),
origins AS (SELECT * FROM voices WHERE coalesce(text, '') <> '')"""

_CAND = _REL + f""", scores AS (SELECT * FROM rel WHERE score >= 0.12),
cand AS (SELECT s.*, provider, provider_no, 'https://x.example.org/'||(doc_id % 50) AS url FROM (
   SELECT claim_id, doc_id, score, 'RSS_CORPUS' AS provider, 0 AS provider_no FROM scores UNION ALL SELECT claim_id, doc_id, score * 0.9::DOUBLE, 'DIRECT_URL', 1 FROM scores) s),
top AS (SELECT *, row_number() OVER (PARTITION BY claim_id, provider ORDER BY score DESC, doc_id) AS provider_rank FROM cand)"""

_P = "(?is)<p(?:\\s[^>]*)?>"
_FEEDS = f"""raw_feeds AS (SELECT s_suppkey AS feed_no, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'https://f'||s_suppkey||'.example.org/rss' END AS url,
   'f'||s_suppkey||'.example.org' AS domain, coalesce(CASE s_suppkey % 3 WHEN 0 THEN 'bn' WHEN 1 THEN 'fr' END, 'en') AS language, '' AS country,
   CASE WHEN s_suppkey % 2 = 0 THEN 'world' ELSE 'general' END AS category, CASE s_suppkey % 5 WHEN 0 THEN 'NOT_A_TYPE' WHEN 1 THEN 'NEWS_AGENCY' ELSE 'UNKNOWN' END AS source_type,
   s_suppkey % 11 <> 0 AS enabled FROM supplier),
feeds AS (SELECT * FROM raw_feeds WHERE url IS NOT NULL AND source_type <> 'NOT_A_TYPE')"""

_REGISTERED = quoted(r[1] for r in V.PRIMARY_SOURCES)
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
_N_REG = len(V.PRIMARY_SOURCES)
_CHROME = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in "script style nav header footer aside form".split():
    _CHROME = f"regexp_replace({_CHROME}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"


def _sql_decode(t: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _sql_plain(fragment: str, sep: str = "' '") -> str:
    pieces = f"list_filter(list_transform(string_split_regex({fragment}, '(?s)<[^>]*>'), lambda x: trim({_sql_decode('x')}, {_WSP})), lambda x: x <> '')"
    return f"array_to_string({pieces}, {sep})"


ORACLES = {
    "submission_intake": """WITH r AS (SELECT *, (conv_id + turn) % 8 AS k, conv_id||'-'||turn AS submission_id FROM conversations),
      j AS (SELECT submission_id, CASE WHEN k = 7 AND turn >= 5 THEN 'nothing_submitted'
          WHEN k < 4 AND NOT (length(CASE WHEN k = 3 THEN repeat(text, 50000 // length(text) + 1) ELSE text END) BETWEEN 10 AND 50000) THEN 'text_length'
          WHEN k = 2 THEN 'title_length' END AS reject_reason,
        CASE WHEN k = 4 THEN 'SOCIAL_URL' WHEN k = 5 THEN 'ARTICLE_URL' WHEN k = 6 AND conv_id % 2 = 0 THEN 'SCREENSHOT'
          WHEN k = 6 AND turn % 3 > 0 THEN 'IMAGE_WITH_CAPTION' WHEN k = 6 THEN 'IMAGE' WHEN k = 7 AND turn < 5 AND turn % 3 > 0 THEN 'VIDEO_WITH_CAPTION'
          WHEN k = 7 AND turn < 5 THEN 'VIDEO' WHEN k < 4 THEN 'TEXT' END AS content_type FROM r)
      SELECT submission_id, CASE WHEN reject_reason IS NULL THEN content_type END AS content_type, reject_reason FROM j""",
    "texts_by_origin": f"WITH {_SPOKEN} SELECT * FROM origins",
    "claims_extract": f"""WITH {_SPOKEN}, s AS (SELECT submission_id, origin_no, origin, unnest(range(len(ss))) AS sentence_no, unnest(ss) AS claim_text
        FROM (SELECT *, ({sql_sentences('text')})[1:25] AS ss FROM origins)),
      t AS (SELECT *, 'en' AS language, {_SQL_TYPE} AS claim_type FROM s WHERE length(claim_text) >= 15)
      SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY origin_no, sentence_no) - 1 AS sequence, origin, language, sentence_no, claim_text, claim_type,
        round(greatest(0.05::DOUBLE, 0.5::DOUBLE + CASE WHEN sentence_no = 0 THEN 0.25::DOUBLE WHEN sentence_no < 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
          - CASE WHEN claim_type IN ('OPINION', 'PREDICTION') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 6) AS importance FROM t""",
    "article_extract": f"""WITH c AS (SELECT page_id, {_sql_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        list_transform(string_split_regex(regexp_replace({_CHROME}, '(?is)</p\\s*>|</article\\s*>|</body\\s*>', chr(1), 'g'), '{_P}')[2:], lambda x: string_split(x, chr(1))[1]) AS ps FROM pages),
      b AS (SELECT page_id, title, array_to_string(list_transform(list_filter(ps, lambda x: length({_sql_plain('x', "''")}) > 40), lambda x: {_sql_plain('x')}), chr(10)||chr(10)) AS body FROM c),
      k AS (SELECT page_id, title, substr(body, 1, 12000) AS body FROM b WHERE body <> '')
      SELECT page_id, nullif(title, '') AS title, NULL::VARCHAR AS canonical_url, body, sha256(body) AS content_hash, FALSE AS injection_detected FROM k""",
    "article_extract_whole": f"""WITH many AS (SELECT page_id // 10 AS page_id, string_agg(regexp_replace(html, '(?i)</?(html|body)[^>]*>', '', 'g'), chr(10) ORDER BY page_id) AS html FROM pages GROUP BY 1),
      c AS (SELECT page_id, {_sql_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        list_transform(string_split_regex(regexp_replace({_CHROME}, '(?is)</p\\s*>|</article\\s*>|</body\\s*>', chr(1), 'g'), '{_P}')[2:], lambda x: string_split(x, chr(1))[1]) AS ps FROM many),
      b AS (SELECT page_id, title, array_to_string(list_transform(list_filter(ps, lambda x: length({_sql_plain('x', "''")}) > 40), lambda x: {_sql_plain('x')}), chr(10)||chr(10)) AS body FROM c),
      k AS (SELECT page_id, title, body FROM b WHERE body <> '')
      SELECT page_id, length(body) AS n_chars, sha256(body) AS content_hash FROM k""",
    "claims_extract_whole": f"""WITH s AS (SELECT doc_id AS submission_id, unnest(range(len(ss))) AS sentence_no, unnest(ss) AS claim_text FROM (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents))
      SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY sentence_no) - 1 AS sequence, sentence_no, claim_text FROM s WHERE length(claim_text) >= 15""",
    "link_extract": f"""WITH p AS (SELECT page_id, {_HOST} AS site, {_sql_decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS t FROM pages),
      l AS (SELECT page_id, site AS site_domain, 'https://www.'||site||'/story/'||page_id AS url, trim(t) AS headline, 0 AS n FROM p
        UNION ALL SELECT page_id, site, 'https://www.'||site||'/story/b'||page_id, t||' again', 1 FROM p),
      w AS (SELECT * FROM l WHERE length(headline) >= 20)
      SELECT page_id, site_domain, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS position, url, headline FROM w""",
    "origin_clusters": f"""WITH {_BASE_DOCS} SELECT 'hash:'||sha256(body) AS cluster_key, 'hash' AS method, count(*) AS member_count,
        arg_min(doc_id, ROW(published_at IS NULL, coalesce(published_at, TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 SECOND * created_no), doc_id)) AS representative_id, 1.0::DOUBLE AS similarity
      FROM bdocs GROUP BY body HAVING count(*) >= 2""",
    "origin_clusters_by_title": f"""WITH {_BASE_DOCS}, k AS (SELECT *, CASE WHEN title <> '' THEN 'title:'||substr(sha256(substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 120)), 1, 16)
        ELSE 'url:'||url END AS key FROM bdocs)
      SELECT split_part(key, ':', 1) AS method, count(*) AS member_count,
        arg_min(doc_id, ROW(published_at IS NULL, coalesce(published_at, TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 SECOND * created_no), doc_id)) AS representative_id
      FROM k GROUP BY key HAVING count(*) >= 2""",
    "cluster_assignment": "SELECT doc_id, cluster_key FROM (SELECT doc_id, 'hash:'||sha256(text) AS cluster_key, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n >= 2",
    "document_upsert": f"""WITH {_BASE_DOCS}, r AS (SELECT 'https://x.example.org/'||(doc_id % 100) AS key, url, title, -1 AS arrival_no, substr(body, 1, 2000) AS excerpt, sha256(body) AS content_hash, least(length(body), 2000) AS size FROM bdocs WHERE doc_id < 100
        UNION ALL SELECT 'https://x.example.org/'||(doc_id % 100), 'https://x.example.org/'||(doc_id % 100)||'/', title, doc_id, substr(body, 1, 2000), sha256(body), length(body) FROM bdocs),
      f AS (SELECT key, arg_min(url, arrival_no) AS url, arg_min(title, arrival_no) AS title FROM r GROUP BY key),
      l AS (SELECT key, excerpt, content_hash FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY (size > 2000)::INT DESC, CASE WHEN size > 2000 THEN arrival_no ELSE size END DESC, arrival_no) = 1)
      SELECT key, url, title, excerpt, content_hash FROM f JOIN l USING (key)""",
    "source_upsert": f"""WITH r AS (SELECT 'src'||(s_suppkey * 2) AS domain, s_name AS name, 'UNKNOWN' AS t, -1 AS n FROM supplier
        UNION ALL SELECT source, CASE WHEN doc_id % 2 = 0 THEN upper(source) END, CASE WHEN doc_id % 4 = 0 THEN 'UNKNOWN' ELSE ([{quoted(_TYPES)}])[doc_id % 11 + 1] END, doc_id FROM documents)
      SELECT domain, arg_min(coalesce(name, domain), n) AS name, coalesce(arg_min(t, n) FILTER (t <> 'UNKNOWN'), 'UNKNOWN') AS source_type FROM r GROUP BY domain""",
    "primary_suffix_join": f"""WITH d AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN reg WHEN 1 THEN host||'.'||reg WHEN 2 THEN 'not'||reg ELSE host END AS domain
        FROM (SELECT page_id, {_HOST} AS host, ([{_REGISTERED}])[page_id % {_N_REG} + 1] AS reg FROM pages))
      SELECT domain, len(list_filter([{_REGISTERED}], lambda r: domain = r OR ends_with(domain, '.'||r))) > 0 AS is_primary FROM d""",
    "feed_registry": f"WITH {_FEEDS} SELECT * FROM feeds",
    "feed_priority": f"""WITH {_FEEDS}, l AS (SELECT DISTINCT lang FROM documents),
      o AS (SELECT lang AS language, feed_no, name, f.language AS feed_language, row_number() OVER (PARTITION BY lang ORDER BY (f.language <> lang)::INT, feed_no) AS priority FROM l, feeds f WHERE enabled)
      SELECT * FROM o WHERE priority <= 20""",
    "relevance_score": _REL + "SELECT claim_id, doc_id, round(score, 6) AS score FROM rel",
    "relevance_score_shuffled": _REL + "SELECT claim_id, doc_id, round(score, 6) AS score FROM rel",
    "phrase_bonus": f"""WITH {CLAIMS}, {_DOCS}, q AS (SELECT claim_id, p, count(*) AS times FROM (SELECT claim_id, unnest({sql_bigrams('claim_tokens')}) AS p FROM claims) GROUP BY ALL),
      d AS (SELECT DISTINCT doc_id AS text_id, unnest({sql_bigrams('tokens')}) AS p FROM docs)
      SELECT claim_id, text_id, sum(times)::BIGINT AS matches, round(least(0.25::DOUBLE, sum(times) * 0.12::DOUBLE), 6) AS bonus FROM q JOIN d USING (p) GROUP BY ALL""",
    "headline_gate": f"""{_REL}, titles AS (SELECT doc_id, {sql_tokens("regexp_extract(text, '^[^.!?\\n]*')")} AS tokens FROM documents), {sql_relevance('trel', 'titles', 'doc_id')}
      SELECT claim_id, doc_id, round(t.score, 6) AS title_score, round(coalesce(r.score, 0), 6) AS body_score,
        round(least(1.0::DOUBLE, t.score * 0.75::DOUBLE + coalesce(r.score, 0) * 0.25::DOUBLE), 6) AS score
      FROM trel t LEFT JOIN rel r USING (claim_id, doc_id) WHERE t.score >= 0.12""",
    "provider_union": _CAND + "SELECT provider, claim_id, count(*) AS n FROM cand GROUP BY ALL",
    "top_candidates": _CAND + "SELECT claim_id, provider, doc_id, provider_rank FROM top WHERE provider_rank <= 10",
    "candidate_dedup": _CAND + """SELECT claim_id, lower(url) AS dedup_key, doc_id, provider, round(score, 6) AS score FROM top WHERE provider_rank <= 40
      QUALIFY row_number() OVER (PARTITION BY claim_id, url ORDER BY score DESC, provider_no, provider_rank, doc_id) = 1""",
    "documents_read": _REL + "," + _TOP + "SELECT claim_id, doc_id, rank, round(score, 6) AS score FROM chosen",
    "query_audit": _REL + """, n AS (SELECT claim_id, count(*) AS c FROM rel WHERE score >= 0.12 GROUP BY 1)
      SELECT q.claim_id, query_no, substr(query, 1, 2000) AS query_text, 'RSS_CORPUS' AS provider, coalesce(c, 0) AS result_count,
        CASE WHEN sequence = 0 THEN 'DIRECT_URL:timeout1; DIRECT_URL:timeout2' END AS error
      FROM queries q JOIN claims USING (claim_id) LEFT JOIN n ON n.claim_id = q.claim_id""",
    "run_totals": _REL + """, n AS (SELECT claim_id, count(*) AS c FROM rel WHERE score >= 0.12 GROUP BY 1), k AS (SELECT claim_id, count(*) AS qn FROM queries GROUP BY 1)
      SELECT submission_id, count(*) AS claims_searched, sum(qn)::BIGINT AS queries_generated, coalesce(sum(c), 0)::BIGINT AS documents_found,
        array_to_string(list_sort(flatten(list([{'s': sequence, 'n': 1}, {'s': sequence, 'n': 2}])))[1:5].list_transform(lambda e: 'timeout '||e.s||'.'||e.n), '; ') AS first_errors
      FROM claims JOIN k USING (claim_id) LEFT JOIN n USING (claim_id) GROUP BY 1""",
    "split_passages": f"WITH pdocs AS (SELECT doc_id, text AS body FROM documents), {_PASSAGES} SELECT * FROM passages",
    "evidence_for_claims": _EVIDENCE + """SELECT claim_id, doc_id, passage_no, passage, relationship, display_rank, source_type, is_primary,
      round(relevance, 6) AS relevance, round(directness, 6) AS directness, rationale, cluster_id IS NOT NULL AS clustered FROM evidence""",
    "claim_verdicts_flagship": _FLAG + """SELECT claim_id, claim_text, verdict, decision_rule, n AS independent_origins, evidence_count, confidence_band,
      round(s, 6) AS support_score, round(c, 6) AS contradiction_score, round(confidence_score, 6) AS confidence_score FROM claim_scores""",
    "submission_verdicts": _FLAG_OVERALL + """SELECT verification_id, overall_verdict, decision_rule, claim_count, confidence_band, round(confidence_score, 6) AS confidence_score FROM overall""",
    "report": _FLAG + """, e AS (SELECT claim_id, count(*) AS n, array_to_string(list_transform(list_sort(list({'r': display_rank, 'd': doc_id}) FILTER (relationship = 'SUPPORTS')), lambda x: x.d), ',') AS sd FROM evidence GROUP BY 1)
      SELECT claim_id, sequence, verdict, coalesce(e.n, 0) AS n_evidence, coalesce(sd, '') AS supporting_docs FROM claim_scores LEFT JOIN e USING (claim_id)""",
}


def _claims_parsed_sql() -> str:
    from workload.texts import _D1, _D2, _D3, _MONEY, _NUM, _PCT, _REL, _sql_entities, _sql_scaled

    def n(pattern: str) -> str:
        return f"len(regexp_extract_all(text, '{pattern}'))"

    blanked = f"regexp_replace(regexp_replace(text, '{_MONEY}', '¤', 'g'), '{_PCT}', '¤', 'g')"
    numbers = f"list_zip(regexp_extract_all({blanked}, '{_NUM}', 1), regexp_extract_all({blanked}, '{_NUM}', 2))"
    kept = f"list_filter({numbers}, lambda z: NOT ({_sql_scaled('z[1]', 'z[2]')} BETWEEN 1900 AND 2100 AND z[2] = '' AND NOT contains(z[1], '.')))"
    raws = f"list_concat(list_concat(list_concat(regexp_extract_all(text, '{_D1}'), regexp_extract_all(text, '{_D2}')), regexp_extract_all(text, '{_D3}')), regexp_extract_all(text, '{_REL}'))"
    years = "list_distinct(regexp_extract_all(text, '\\b(1[89]\\d{2}|20\\d{2})\\b'))"
    loose = f"len(list_filter({years}, lambda y: len(list_filter({raws}, lambda d: contains(d, y))) = 0))"
    return f"""WITH {CLAIMS}, ct AS (SELECT claim_id, claim_text AS text FROM claims),
      e AS (SELECT claim_id, count(*) AS n FROM ({_sql_entities('ct', 'claim_id')}) GROUP BY 1)
      SELECT claim_id, {n(_MONEY)} AS n_money, {n(_PCT)} AS n_percentages, len({kept}) AS n_numbers, len({raws}) + {loose} AS n_dates, coalesce(e.n, 0) AS n_entities
      FROM ct LEFT JOIN e USING (claim_id)"""


ORACLES["claims_parsed"] = _claims_parsed_sql()


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\x{0980}-\\x{09ff}]+')"
_LINKS = f"""WITH RECURSIVE {_BASE_DOCS},
t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), n AS (SELECT doc_id, ('0x'||substr(md5(w), 1, 15))::BIGINT AS h FROM t),
bits AS (SELECT doc_id, count(*) AS c, {", ".join(f"count(*) FILTER ((h >> {i}) & 1 = 1) AS b{i}" for i in range(60))} FROM n GROUP BY 1),
sim AS (SELECT doc_id, {" + ".join(f"(CASE WHEN 2 * b{i} > c THEN 1::BIGINT << {i} ELSE 0 END)" for i in range(60))} AS h FROM bits
        UNION ALL SELECT doc_id, 0 FROM documents WHERE len({_TOKENS}) = 0),
keyed AS (SELECT doc_id, 'url' AS kind, 'https://wire.example.org/'||(doc_id // 30) AS key FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT doc_id, 'hash', sha256(text) FROM documents
  UNION ALL SELECT doc_id, 'simhash', h::VARCHAR FROM sim
  UNION ALL SELECT doc_id, 'title', k FROM (SELECT doc_id, substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 120) AS k FROM bdocs) WHERE length(k) >= 20),
stars AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY kind, key) AS b, kind FROM keyed),
hv AS (SELECT h, min(doc_id) AS rep FROM sim GROUP BY 1),
el AS (SELECT a, b, kind FROM stars WHERE a <> b
  UNION ALL SELECT a.rep, z.rep, 'simhash' FROM hv a JOIN hv z ON a.h < z.h AND bit_count(xor(a.h, z.h)) <= 3),
eb AS (SELECT a, b, kind FROM el UNION ALL SELECT b, a, kind FROM el),
reach AS (SELECT DISTINCT a AS node, a AS got FROM eb UNION SELECT r.node, e.b FROM reach r JOIN eb e ON e.a = r.got),
member AS (SELECT node AS doc_id, min(got) AS cluster_id FROM reach GROUP BY 1),
kinds AS (SELECT a AS doc_id, arg_min(kind, list_position(['url', 'hash', 'simhash', 'title'], kind)) AS joined_by FROM eb GROUP BY 1)"""
ORACLES["origin_links_assignment"] = f"{_LINKS} SELECT doc_id, cluster_id, joined_by FROM member JOIN kinds USING (doc_id)"
ORACLES["origin_links_clusters"] = f"""{_LINKS} SELECT cluster_id, count(*) AS member_count, array_to_string(list_sort(list_distinct(list(joined_by))), ',') AS methods,
  arg_min(doc_id, ROW(published_at IS NULL, coalesce(published_at, TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 SECOND * created_no), doc_id)) AS representative_id
  FROM member JOIN kinds USING (doc_id) JOIN bdocs USING (doc_id) GROUP BY 1"""
