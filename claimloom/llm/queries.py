"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import (
    centroids,
    contamination,
    exact_dedup,
    fingerprints,
    hard_negatives,
    html_text,
    jaccard_join,
    language,
    packing,
    pieces,
    substrings,
    token_counts,
    warc,
)
from claimloom.llm.shared import scratch, table

_WHITE_SQL = r"'[\x20\x09-\x0D]+'"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


_OP7 = f"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), {_WHITE_SQL}, ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""



def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), with_ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.trained_on_the_rest(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, payloads=False).where("record_type <> 'gap'")
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    first = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    return found.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif(first, F.lit("")).cast("long").alias("refers_to"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP11_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP11 = f"""
WITH d AS (SELECT doc_id, {_OP11_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_OP11_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[p:p + least(10, len(w)) - 1] AS run
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p)
  WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT len(run) AS n FROM windows),
runs AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS run
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p)
),
hits AS (SELECT doc_id, p, n, item_id FROM runs JOIN windows USING (run)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(n)) AS t(k) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Rounds of exact nearest centroids, unrolled."""
    parts = [
        """v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        """c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, w AS c
  FROM (SELECT w, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)
)""",
    ]
    for i in range(6):
        parts.append(f"""a{i} AS (
  SELECT vec_id, w, unnest(best) FROM (
    SELECT vec_id, any_value(w) AS w, min({{'distance': d, 'cluster': cluster}}) AS best FROM (
      SELECT vec_id, w, cluster, CAST(list_sum(list_transform(list_zip(w, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM v, c{i}
    ) GROUP BY vec_id
  )
)""")
        if i < 5:
            parts.append(f"""m{i} AS (
  SELECT cluster, list(t ORDER BY p) AS c FROM (
    SELECT cluster, p, CAST(sum(w[p]) AS BIGINT) AS s, count(*) AS n,
           (s - ((s % n) + n) % n) // n AS t
    FROM a{i}, unnest(range(1, 65)) AS u(p) GROUP BY cluster, p
  ) GROUP BY cluster
),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), label=moved, anchor=F.col("vec_id") % 50 == 0)


_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.w, r.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS a, v AS r WHERE a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id AND len(a.w) = len(r.w)
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 3
"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_decontamination": op11_decontamination,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op7_exact_dedup": _OP7,
    "op11_decontamination": _OP11,
    "op12_centroid_clustering": _op12_sql(),
    "op13_hard_negatives": _OP13,
}
