"""Labelling queries: markers, figures, passage labels, external labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import figures as G
from claimloom.functions import text as X
from claimloom.operators import evidence as E
from workload import scoring as W
from workload.base import quoted, sql_tokens, table
from workload.texts import _MONEY, _NUM, _sql_scaled

_MARKED = [
    "", " It was denied, no evidence found.", " The rumor is FALSE; it was not so.", " অভিযোগটি মিথ্যা, সত্য নয়।", " মুনাফা বেড়েছে north notes",
    " Officials confirmed it, according to a statement.", " \"Never happened\" was said (reported).",
]


def marker_count(spark, sf):
    extra = F.element_at(F.array(*[F.lit(m) for m in _MARKED]), (F.col("doc_id") % len(_MARKED) + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", F.lower(F.concat("text", extra)).alias("t")).withColumn("w", E.marker_words(F.col("t")))
    return rows.select(
        "doc_id",
        (E.count_markers(F.col("t"), F.col("w"), V.NEGATION_EN) + E.count_markers(F.col("t"), F.col("w"), V.NEGATION_BN)).alias("negations"),
        E.count_markers(F.col("t"), F.col("w"), V.CONFIRMATION_EN).alias("confirmations"),
    )


# Passages about an order, one per way of agreeing or not with the claim about it.
_FORMS = [
    "Records show the shipment from Harbour City cost ${a} million to deliver, auditors wrote.",
    "Records show the shipment from Harbour City cost ${b} million to deliver, auditors wrote.",
    "The shipment from Harbour City did not cost that much to deliver, a rumor said.",
    "A shipment from Harbour City was confirmed to deliver at cost, the office announced.",
    "Shipment from Harbour City cost to deliver again and again without figures.",
    "Completely unrelated prose about gardens, weather and distant music festivals.",
    "Harbour City counted {c} ships in 1999 and again 1999.5 tons of cargo.",
]


def _pairs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    amount = F.format_number("o_totalprice", 2)
    double = F.format_number(F.col("o_totalprice") * 2, 2)
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int"))
    passage = F.replace(F.replace(F.replace(form, F.lit("{a}"), amount), F.lit("{b}"), double), F.lit("{c}"), F.col("o_custkey").cast("string"))
    claim = F.concat(F.lit("The shipment from Harbour City cost $"), amount, F.lit(" million to deliver."))
    rows = o.select("o_orderkey", claim.alias("claim_text"), passage.alias("passage"), F.lit("en").alias("language"))
    return X.with_tokens(X.with_tokens(rows, "claim_text", "claim_tokens"), "passage", "passage_tokens")


def passage_label(spark, sf):
    return E.label_passages(_pairs(spark, sf)).select(
        "o_orderkey", "relationship", "label_confidence", F.round("directness", 6).alias("directness"), "rationale"
    )


def numeric_conflict(spark, sf):
    p = _pairs(spark, sf)
    c = G.numeric_conflict(G.comparable_numbers(F.col("claim_text")), G.comparable_numbers(F.col("passage")))
    return p.select("o_orderkey", c.alias("c")).select("o_orderkey", "c.conflict", "c.claim_value", "c.passage_value")


_REPLIES = [
    '{"relationship": "SUPPORTS", "directness": 0.9, "confidence": 0.8, "reason": "match R"}',
    'Sure! ```json {"relationship": "CONTRADICTS", "reason": "other figure R"} ``` done',
    '{"relationship": "MAYBE", "reason": "x"}', '{"relationship": "NEUTRAL", "directness": 1.5, "reason": "x"}', "no object here", '{"relationship": "NEUTRAL"}',
]


def _replies(spark, sf) -> DataFrame:
    o = table(spark, sf, "lineitem")
    form = F.element_at(F.array(*[F.lit(r) for r in _REPLIES]), (F.col("l_partkey") % len(_REPLIES) + 1).cast("int"))
    return o.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.replace(form, F.lit("R"), F.lit("R")).alias("raw"))


def label_json_parse(spark, sf):
    return _replies(spark, sf).select("evidence_id", E.parse_labels(F.col("raw")).alias("l")).select(
        "evidence_id", F.col("l.relationship").alias("relationship"), F.col("l.directness").alias("directness"), F.col("l.confidence").alias("confidence"), F.col("l.reason").alias("reason")
    )


def label_override(spark, sf):
    ev = W.evidence(spark, sf).select(
        "evidence_id", "claim_id", "relationship", "directness", F.lit("lexical").alias("rationale"), F.lit(0.4).alias("label_confidence"), F.lit("lexical").alias("classifier")
    )
    return E.override_labels(ev, _replies(spark, sf)).withColumn("directness", F.round("directness", 6))


def fallback_article(spark, sf):
    """Documents as candidates: pages of the same number are their articles."""
    d = table(spark, sf, "documents")
    cand = d.select(
        "doc_id", F.concat(F.lit("u"), (F.col("doc_id") % 400).cast("string")).alias("url"), F.lit(None).cast("string").alias("canonical_url"), F.col("source").alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("summary"), F.lit(None).cast("timestamp").alias("published_at"),
    )
    art = table(spark, sf, "pages").select(
        F.concat(F.lit("u"), "page_id").alias("url"), F.col("html").alias("body"), F.when(F.col("page_id") % 2 == 0, F.lit("T")).alias("title"),
        F.lit("").alias("canonical_url"), F.lit(None).cast("timestamp").alias("published_at"),
    )
    return E.with_article(cand, art).select("doc_id", "url", "title", "body", "canonical_url")


QUERIES = {f.__name__: f for f in (marker_count, passage_label, numeric_conflict, label_json_parse, label_override, fallback_article)}


def _sql_markers(markers, text: str = "t") -> str:
    singles = quoted(m for m in markers if " " not in m)
    phrases = " + ".join(f"contains({text}, '{m}')::INT" for m in markers if " " in m)
    words = f"list_transform(string_split_regex({text}, '\\s+'), lambda w: trim(w, ' .,;:!?()[]{{}}\"''‘’“”।–—-'))"
    return f"(len(list_distinct(list_filter({words}, lambda w: w IN ({singles})))){' + ' + phrases if phrases else ''})"


def _sql_values(text: str) -> str:
    """List of comparable numbers of a text."""
    num = f"list_zip(regexp_extract_all({text}, '{_NUM}', 1), regexp_extract_all({text}, '{_NUM}', 2))"
    money = f"list_zip(regexp_extract_all({text}, '{_MONEY}', 2), regexp_extract_all({text}, '{_MONEY}', 3))"
    plain = f"list_transform(list_filter({num}, lambda z: NOT ({_sql_scaled('z[1]', 'z[2]')} BETWEEN 1900 AND 2100 AND z[2] = '' AND NOT contains(z[1], '.'))), lambda z: {_sql_scaled('z[1]', 'z[2]')})"
    valued = f"list_transform({money}, lambda z: {_sql_scaled('z[1]', 'z[2]')})"
    return f"list_filter(list_concat({plain}, {valued}), lambda v: NOT (v BETWEEN 1900 AND 2100 AND floor(v) = v))"


_PAIRS = f"""pairs AS (SELECT o_orderkey, 'The shipment from Harbour City cost $'||format('{{:,.2f}}', o_totalprice)||' million to deliver.' AS claim_text,
  replace(replace(replace(([{quoted(_FORMS)}])[o_orderkey % {len(_FORMS)} + 1], '{{a}}', format('{{:,.2f}}', o_totalprice)), '{{b}}', format('{{:,.2f}}', o_totalprice * 2)), '{{c}}', o_custkey::VARCHAR) AS passage FROM orders),
vals AS (SELECT *, list_distinct({_sql_values('claim_text')}) AS cv, list_distinct({_sql_values('passage')}) AS pv, {sql_tokens('claim_text')} AS ct, {sql_tokens('passage')} AS pt FROM pairs),
facts AS (SELECT *, len(list_intersect(ct, pt))::DOUBLE / greatest(len(list_distinct(ct)), 1)::DOUBLE AS overlap, lower(passage) AS t,
  list_filter(cv, lambda c: c <> 0 AND len(list_filter(pv, lambda p: abs(c - p) / greatest(abs(c), 1.0) <= 0.02)) = 0
     AND len(list_filter(pv, lambda p: p <> 0 AND greatest(c, p) / least(c, p) BETWEEN 1.5 AND 20)) > 0) AS cc FROM vals),
judged AS (SELECT *, len(cc) > 0 AS conflict, cc[1] AS claim_value, list_filter(pv, lambda p: p <> 0 AND greatest(cc[1], p) / least(cc[1], p) BETWEEN 1.5 AND 20)[1] AS passage_value,
  list_sort(list_intersect(cv, pv)) AS same, {_sql_markers(V.NEGATION_EN + V.NEGATION_BN)} AS negations, {_sql_markers(V.CONFIRMATION_EN)} AS confirmations FROM facts)"""

_BRANCH = "CASE WHEN conflict AND overlap >= 0.25 AND NOT contains(passage, '1999.5') THEN 1 WHEN negations >= 1 AND overlap >= 0.3 THEN 2 WHEN len(same) > 0 AND overlap >= 0.25 THEN 3 WHEN overlap >= 0.5 AND confirmations >= 1 THEN 4 WHEN overlap >= 0.65 THEN 5 ELSE 6 END"
_REPLY_SQL = f"""replies AS (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS evidence_id, l_partkey % {len(_REPLIES)} AS k FROM lineitem),
parsed AS (SELECT evidence_id, CASE k WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CONTRADICTS' END AS relationship, CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS directness,
  CASE k WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS confidence, CASE k WHEN 0 THEN 'match R' WHEN 1 THEN 'other figure R' END AS reason FROM replies)"""

ORACLES = {
    "marker_count": f"""WITH d AS (SELECT doc_id, lower(text||([{quoted(_MARKED)}])[doc_id % {len(_MARKED)} + 1]) AS t FROM documents)
      SELECT doc_id, {_sql_markers(V.NEGATION_EN)} + {_sql_markers(V.NEGATION_BN)} AS negations, {_sql_markers(V.CONFIRMATION_EN)} AS confirmations FROM d""",
    "numeric_conflict": f"WITH {_PAIRS} SELECT o_orderkey, conflict, claim_value, CASE WHEN conflict THEN passage_value END AS passage_value FROM judged",
    "passage_label": f"""WITH {_PAIRS}, b AS (SELECT *, {_BRANCH} AS k, least(1.0::DOUBLE, overlap * 1.4::DOUBLE) AS d FROM judged)
      SELECT o_orderkey, ['CONTRADICTS', 'CONTRADICTS', 'SUPPORTS', 'SUPPORTS', 'SUPPORTS', 'NEUTRAL'][k] AS relationship, [0.7::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.6::DOUBLE, 0.5::DOUBLE, 0.4::DOUBLE][k] AS label_confidence,
        round(CASE WHEN k = 3 THEN greatest(d, 0.7::DOUBLE) ELSE d END, 6) AS directness,
        CASE k WHEN 1 THEN 'Numeric disagreement: claim states '||printf('%g', claim_value)||', source states '||printf('%g', passage_value)
          WHEN 2 THEN 'Passage uses explicit denial or correction language about this claim.'
          WHEN 3 THEN 'Passage reports the same figure ('||array_to_string(list_transform(same, lambda v: printf('%g', v)), ', ')||') for the same subject.'
          WHEN 4 THEN 'Passage reports the same facts in affirmative terms.' WHEN 5 THEN 'Passage closely restates the claim.'
          ELSE 'Passage is topically related but does not confirm or deny the claim.' END AS rationale FROM b""",
    "label_json_parse": f"WITH {_REPLY_SQL} SELECT * FROM parsed",
    "label_override": W._W + f""", {_REPLY_SQL} SELECT ev.evidence_id, claim_id, coalesce(p.relationship, ev.relationship) AS relationship, round(coalesce(p.directness, ev.directness), 6) AS directness,
        coalesce(reason, 'lexical') AS rationale, coalesce(confidence, 0.4::DOUBLE) AS label_confidence, CASE WHEN p.relationship IS NULL THEN 'lexical' ELSE 'llm' END AS classifier
      FROM ev LEFT JOIN (SELECT DISTINCT * FROM parsed) p ON p.evidence_id = ev.evidence_id""",
    "fallback_article": """WITH c AS (SELECT doc_id, 'u'||(doc_id % 400) AS url, source, CASE WHEN doc_id % 7 <> 0 THEN text END AS summary FROM documents)
      SELECT doc_id, c.url, coalesce(CASE WHEN page_id % 2 = 0 THEN 'T' END, source) AS title, coalesce(html, summary) AS body, NULL::VARCHAR AS canonical_url
      FROM c LEFT JOIN pages ON 'u'||page_id = c.url WHERE coalesce(html, nullif(summary, '')) IS NOT NULL""",
}
