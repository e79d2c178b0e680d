"""Origin clusters over several kinds of link: connected components of canonical URL, body, near-body and title.

Documents that share a key of one kind are linked to the key's smallest document, so a thousand copies are a
thousand links and not all pairs; near bodies come as pairs of distinct hash values.  A document's component is its
origin cluster, and the kinds of its own links say what joined it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as X
from claimloom.operators.declared import near_hashes
from claimloom.operators.skew import salted_join
from claimloom.session import cut_lineage

#: Kinds of link, the surest first.
KINDS = ("url", "hash", "simhash", "title")
#: Shorter titles say too little to join two reports.
TITLE_LENGTH = 20


def title_key(title: Column) -> Column:
    """The first 120 characters in lower case with single spaces; null where the title is short."""
    key = F.substring(X.strip(F.regexp_replace(F.lower(title), X.WS + "+", " ")), 1, 120)
    return F.when(F.length(key) >= TITLE_LENGTH, key)


def starred(documents: DataFrame, key: Column, kind: str) -> DataFrame:
    """(a, b, kind): each document of a key that several hold, with the smallest of them."""
    held = documents.select("doc_id", F.sha2(key.cast("string"), 256).alias("_key")).where(F.col("_key").isNotNull())
    held = cut_lineage(held)
    groups = held.groupBy("_key").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = salted_join(held, groups.select("_key", "b"), "_key", ["doc_id"], counts=groups.select("_key", "n"))
    return met.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b", F.lit(kind).alias("kind"))


def origin_links(documents: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b, kind) of documents(doc_id, canonical_url, content_hash, simhash, title); a null key links nothing,
    nor does an empty canonical URL."""
    url = F.nullif(F.lower(F.regexp_replace("canonical_url", "/+$", "")), F.lit(""))
    near = near_hashes(documents.where("simhash IS NOT NULL"), "doc_id", "simhash", max_distance)
    pairs = near.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b"), F.lit("simhash").alias("kind"))
    parts = [
        starred(documents, url, "url"), starred(documents, F.col("content_hash"), "hash"),
        starred(documents, F.col("simhash"), "simhash"), pairs, starred(documents, title_key(F.col("title")), "title"),
    ]
    return reduce(DataFrame.unionByName, parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches.

    Each round hangs a node's tree under the least label beside it and then halves the way to the root, so
    that rounds grow with the logarithm of the longest chain.  Labels of neighbours are reduced map-side; a node
    of very many edges is met in a salted join."""
    both = cut_lineage(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        # the least label beside each node, hung under the root that the node has now
        beside = salted_join(both.withColumnRenamed("b", "node"), labels, "node", ["a"])
        least = beside.groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(least, F.col("node") == F.col("a")).select("node", "label", "near")
        roots = seen.groupBy("label").agg(F.min("near").alias("near")).where("near < label")
        hung = cut_lineage(roots.select(F.col("label").alias("root"), "near"))
        if hung.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        way = hung
        while True:  # the way from each root that moved to one that did not
            nxt = way.select(F.col("root").alias("at"), F.col("near").alias("beyond"))
            step = cut_lineage(way.join(nxt, F.col("near") == F.col("at"), "left").select("root", F.coalesce("beyond", "near").alias("near"), "at"))
            way = step.select("root", "near")
            if step.where("at IS NOT NULL").isEmpty():
                break
        labels = cut_lineage(
            salted_join(labels.withColumnRenamed("label", "root"), way, "root", ["node"], "left").select("node", F.coalesce("near", "root").alias("label"))
        )


def linked_origins(documents: DataFrame, max_distance: int = 3) -> DataFrame:
    """doc_id, cluster_id (its smallest document), joined_by (the surest kind of the document's own links) of every
    document that has a link."""
    links = cut_lineage(origin_links(documents, max_distance))
    own = links.select(F.col("a").alias("doc_id"), "kind").unionByName(links.select(F.col("b").alias("doc_id"), "kind"))
    rank = reduce(lambda out, i: F.when(F.col("kind") == KINDS[i], i).otherwise(out), range(len(KINDS)), F.lit(len(KINDS)))
    surest = own.groupBy("doc_id").agg(F.min_by("kind", rank).alias("joined_by"))
    found = components(links)
    return surest.join(found, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("cluster_id"), "joined_by")


def linked_clusters(documents: DataFrame, max_distance: int = 3) -> DataFrame:
    """A row per cluster: cluster_id, member_count, methods (sorted) and representative_id, the earliest published
    (unknown dates last), then first created; documents also has published_at and created_at."""
    member = cut_lineage(linked_origins(documents, max_distance))
    earliest = F.struct(F.col("published_at").isNull(), F.coalesce("published_at", "created_at"), F.col("doc_id"))
    dates = documents.select("doc_id", "published_at", "created_at")
    return member.join(dates, "doc_id").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.array_join(F.sort_array(F.collect_set("joined_by")), ",").alias("methods"),
        F.min_by("doc_id", earliest).alias("representative_id"),
    )
