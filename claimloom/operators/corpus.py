"""The document corpus: articles from pages, links, stores, origin clusters, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.functions import web as U
from claimloom.operators.skew import salted_join


def articles(pages: DataFrame, max_chars: int | None = V.MAX_ARTICLE_CHARS) -> DataFrame:
    """pages(page_id, url, html) -> readable articles; pages without body text are left out.  Bodies are cut to
    max_chars; None keeps them whole."""
    parts = U.article_columns(F.col("html"))
    return (
        pages.select("page_id", "url", *[c.alias(n) for n, c in parts.items()])
        .withColumn("body", U.article_text(F.col("paragraphs"), max_chars))
        .drop("paragraphs")
        .where(F.col("body").isNotNull())
        .withColumn("content_hash", X.body_hash(F.col("body")))
        .withColumn("injection_signals", X.injection_signals(F.col("body")))
        .withColumn("injection_detected", F.size("injection_signals") > 0)
    )


def page_links(pages: DataFrame, k: int = V.LINKS_PER_PAGE) -> DataFrame:
    """pages(page_id, site_domain, html) -> headline links of a result page.

    Anchors come out in page order; the first of each URL counts, at most k per page.  Both the
    order and the cap are local to one page, so nothing is shuffled.
    """
    raw = pages.select(
        "page_id",
        "site_domain",
        F.arrays_zip(
            X.find_all(F.col("html"), U.ANCHOR, 1).alias("href"),
            X.find_all(F.col("html"), U.ANCHOR, 2).alias("inner"),
        ).alias("anchors"),
    )
    site = F.col("site_domain")
    links = F.transform(
        F.col("anchors"),
        lambda a: F.struct(
            U.absolute_url(X.decode_entities(a["href"]), site).alias("url"),
            U.anchor_text(a["inner"]).alias("headline"),
        ),
    )
    wanted = F.filter(
        F.col("links"),
        lambda x: (F.length(x["headline"]) >= V.MIN_HEADLINE)
        & F.contains(x["url"], site)
        & ~x["url"].rlike(U.NAVIGATION),
    )
    first = F.aggregate(
        F.col("wanted"),
        F.array().cast("array<struct<url:string,headline:string>>"),
        lambda kept, x: F.when(
            F.exists(kept, lambda y: y["url"] == x["url"]) | (F.size(kept) >= k), kept
        ).otherwise(F.array_append(kept, x)),
    )
    listed = raw.withColumn("links", links).withColumn("wanted", wanted)
    return X.unnest(listed, ["page_id", "site_domain"], first, "link", "position").select(
        "page_id", "site_domain", "position", "link.*"
    )


def upsert_documents(existing: DataFrame, incoming: DataFrame, cap: int = V.EXCERPT_CHARS) -> DataFrame:
    """Merge incoming(arrival_no, url, canonical_url, title, body) into the document store
    (key, url, title, excerpt, content_hash).  cap is the length of an excerpt.

    A stored row keeps its identity; its excerpt and hash change only when a longer body
    arrives, step by step in arrival order.  Since a stored excerpt is never longer than the
    cap, each arrival beyond the cap replaces the last: the winner is the latest body longer
    than the cap, else the earliest of the longest bodies.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = incoming.select(
        F.rtrim(F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url")), F.lit("/")).alias("key"),
        "url", "title", "arrival_no",
        F.substring(body, 1, cap).alias("excerpt"),
        X.body_hash(body).alias("content_hash"),
        F.length(body).alias("size"),
    ).unionByName(
        existing.select(
            "key", "url", "title", F.lit(-1).cast("long").alias("arrival_no"), "excerpt", "content_hash",
            F.length("excerpt").alias("size"),
        )
    )
    over = F.col("size") > cap
    rank = F.struct(
        over.alias("over"),
        F.when(over, F.col("arrival_no")).otherwise(F.col("size")).alias("a"),
        F.when(over, F.lit(0)).otherwise(-F.col("arrival_no")).alias("b"),
    )
    first = F.struct("url", "title")
    last = F.struct("excerpt", "content_hash")
    # min_by and max_by aggregate map-side: a key with very many arrivals is no hot group
    merged = rows.groupBy("key").agg(
        F.min_by(first, F.col("arrival_no")).alias("f"), F.max_by(last, rank).alias("l")
    )
    return merged.select("key", "f.url", "f.title", "l.excerpt", "l.content_hash")


def upsert_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge incoming(arrival_no, domain, name, source_type) into sources(domain, name, source_type).

    The first row of a domain creates it (name defaults to the domain); an UNKNOWN type takes
    the first known type that arrives.
    """
    rows = existing.select("domain", "name", "source_type", F.lit(-1).cast("long").alias("arrival_no")).unionByName(
        incoming.where(F.coalesce(F.col("domain"), F.lit("")) != "").select(
            "domain", "name", "source_type", F.col("arrival_no").cast("long").alias("arrival_no")
        )
    )
    known = F.col("source_type") != "UNKNOWN"
    return rows.groupBy("domain").agg(
        F.coalesce(
            F.min_by(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("domain")), F.col("arrival_no")),
            F.col("domain"),
        ).alias("name"),
        F.coalesce(
            F.min_by(F.when(known, F.col("source_type")), F.when(known, F.col("arrival_no"))),
            F.lit("UNKNOWN"),
        ).alias("source_type"),
    )


def cluster_key() -> Column:
    """hash of the body, else of the normalised title, else the URL."""
    title = F.substring(
        X.strip(F.regexp_replace(F.lower(F.col("title")), X.WS + "+", " ")), 1, 120
    )
    return (
        F.when(F.col("content_hash").isNotNull(), F.concat(F.lit("hash:"), F.col("content_hash")))
        .when(
            F.coalesce(F.col("title"), F.lit("")) != "",
            F.concat(F.lit("title:"), F.substring(F.sha2(title, 256), 1, 16)),
        )
        .otherwise(F.concat(F.lit("url:"), F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url"))))
    )


def origin_clusters(documents: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Groups of two or more copies of one report.

    documents(doc_id, content_hash, title, canonical_url, url, published_at, created_at);
    `within` names columns that keep groups apart (a claim, a verification).  Returns one row
    per cluster: key, method, member_count, representative_id, similarity.
    """
    within = within or []
    earliest = F.struct(
        F.col("published_at").isNull(), F.coalesce("published_at", "created_at"), F.col("doc_id")
    )
    return (
        documents.withColumn("cluster_key", cluster_key())
        .groupBy(*within, "cluster_key")
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.min_by("doc_id", earliest).alias("representative_id"),
        )
        .where(F.col("member_count") >= 2)
        .withColumn("method", F.substring_index("cluster_key", ":", 1))
        .withColumn("similarity", F.lit(1.0))
    )


def cluster_assignment(documents: DataFrame) -> DataFrame:
    """(doc_id, cluster_key) for documents that have a copy.

    One group of copies may hold a large share of the corpus, so the join back is salted; the
    hot keys are read off the cluster sizes already counted.
    """
    keyed = documents.withColumn("cluster_key", cluster_key())
    clusters = origin_clusters(documents).select("cluster_key", F.col("member_count").alias("n"))
    return salted_join(
        keyed.select("doc_id", "cluster_key"), clusters.select("cluster_key"), "cluster_key", ["doc_id"], counts=clusters
    )


def primary_flags(domains: DataFrame, registry: DataFrame) -> DataFrame:
    """domains(domain) -> (domain, is_primary): equal to or below a registered domain.

    Each domain is exploded into its own suffixes and met by equality, never compared with
    every registry row.
    """
    bare = F.regexp_replace(F.lower(F.col("domain")), r"^www\.", "")
    hits = (
        X.unnest(domains, ["domain"], U.domain_suffixes(bare), "registered")
        .join(registry.select(F.col("domain").alias("registered")).distinct(), "registered", "left_semi")
        .select("domain")
        .distinct()
        .withColumn("is_primary", F.lit(True))
    )
    return domains.join(hits, "domain", "left").fillna({"is_primary": False})


def fresh_snapshots(fetches: DataFrame, as_of: Column, ttl_seconds: int = V.FEED_TTL_SECONDS) -> DataFrame:
    """Latest fetch per feed of fetches(feed, fetched_at, ...), flagged fresh within the TTL."""
    others = [c for c in fetches.columns if c not in ("feed", "fetched_at")]
    latest = fetches.groupBy("feed").agg(
        F.max(F.struct("fetched_at", *others)).alias("s")
    )
    age = F.unix_timestamp(as_of) - F.unix_timestamp("fetched_at")
    return latest.select("feed", "s.*").withColumn("age_seconds", age).withColumn("is_fresh", age < ttl_seconds)


def feed_priority(feeds: DataFrame, languages: DataFrame, k: int = V.FEEDS_PER_QUERY) -> DataFrame:
    """The first k enabled feeds(feed_no, language, enabled, ...) for each language of
    languages(language): matching feeds first, registry order within.

    Feeds that match come from an equality join; the rest of the list is the first k feeds of
    any language, which bounds it before it meets the languages.
    """
    enabled = feeds.where(F.col("enabled")).select("feed_no", "name", F.col("language").alias("feed_language"))
    by_language = Window.partitionBy("feed_language").orderBy("feed_no")
    matching = (
        languages.join(
            enabled.withColumn("r", F.row_number().over(by_language)).where(F.col("r") <= k).drop("r"),
            F.col("language") == F.col("feed_language"),
        )
        .withColumn("mismatch", F.lit(0))
    )
    # the registry's first 2k feeds hold the first k of another language, unless matching feeds
    # fill that head, in which case those feeds rank first anyway
    head = (
        enabled.orderBy("feed_no")
        .limit(2 * k)
        .agg(F.sort_array(F.collect_list(F.struct("feed_no", "name", "feed_language"))).alias("head"))
    )
    others = (
        languages.withColumn("head", head.scalar())
        .select("language", F.explode("head").alias("f"))
        .select("language", "f.*")
        .where(F.col("feed_language") != F.col("language"))
        .withColumn("mismatch", F.lit(1))
    )
    order = Window.partitionBy("language").orderBy("mismatch", "feed_no")
    return (
        matching.unionByName(others)
        .withColumn("priority", F.row_number().over(order))
        .where(F.col("priority") <= k)
        .drop("mismatch")
    )
