"""Table access and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom import vocab as V
from claimloom.operators.skew import spread

T = "\t\n\r "


def table(spark: SparkSession, sf: str, name: str, most_rows: int | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spread(spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet"), most_rows)


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def sql_case(expr: str, pairs: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {expr} = '{k}' THEN {v}" for k, v in pairs.items())
    return f"CASE {arms} ELSE {default} END"


def sql_sentences(text: str) -> str:
    """List of sentences of a text expression."""
    out = text
    for abbreviation in V.ABBREVIATIONS:
        pattern = abbreviation.replace(".", "\\.")
        parts = "||chr(1)||".join(f"'{p}'" for p in abbreviation.split("."))
        out = f"regexp_replace({out}, '{pattern}', {parts}, 'gi')"
    out = f"regexp_replace({out}, '(\\d)\\.(\\d)', '\\1'||chr(1)||'\\2', 'g')"
    out = f"string_split(regexp_replace({out}, '([.!?।])\\s+', '\\1'||chr(2), 'g'), chr(2))"
    trimmed = f"list_transform({out}, lambda x: trim(replace(x, chr(1), '.'), ' '||chr(9)||chr(10)||chr(13)))"
    return f"list_filter({trimmed}, lambda x: x <> '')"


TOKEN = "[\\p{L}\\p{N}_\\x{0980}-\\x{09ff}]+"


def sql_stem(t: str) -> str:
    bn = " ".join(
        f"WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 3} THEN left({t}, length({t}) - {len(s)})"
        for s in sorted(V.BENGALI_SUFFIXES, key=len, reverse=True)
    )
    en = f"WHEN ends_with({t}, 'ies') AND length({t}) >= 7 THEN left({t}, length({t}) - 3)||'y' " + " ".join(
        f"WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 4} THEN left({t}, length({t}) - {len(s)})"
        for s in ("ing", "ed", "es", "s")
    )
    return (
        f"CASE WHEN regexp_matches({t}, '[\\x{{0980}}-\\x{{09ff}}]') THEN CASE {bn} ELSE {t} END "
        f"ELSE CASE {en} ELSE {t} END END"
    )


def sql_tokens(text: str) -> str:
    """List of tokens of a text expression."""
    raw = f"regexp_extract_all(lower(translate({text}, '{V.BENGALI_DIGITS}', '0123456789')), '{TOKEN}')"
    kept = f"list_filter({raw}, lambda t: length(t) >= 2 AND t NOT IN ({quoted(V.STOP_WORDS_EN + V.STOP_WORDS_BN)}))"
    return f"list_transform({kept}, lambda t: {sql_stem('t')})"


def sql_is_number(t: str) -> str:
    return f"regexp_full_match({t}, '\\d+')"


def sql_discriminating(t: str) -> str:
    return f"((length({t}) >= 6 OR {sql_is_number(t)}) AND {t} NOT IN ({quoted(V.LOW_INFORMATION)}))"


def sql_longest(tokens: str, min_len: int, k: int) -> str:
    """The k longest distinct tokens, ties by first position, as a list."""
    ranked = (
        f"list_sort(list_transform(list_filter({tokens}, lambda t: length(t) >= {min_len}), "
        f"lambda t: {{'n': -length(t), 'i': list_position({tokens}, t), 't': t}}))"
    )
    distinct = f"list_sort(list_distinct({ranked}))"
    return f"list_transform(({distinct})[1:{k}], lambda s: s.t)"


def sql_queries(claim: str, tokens: str) -> str:
    """List of query strings of a claim (before case-insensitive distinct)."""
    significant = f"list_filter({tokens}, lambda t: length(t) >= 4 OR {sql_is_number('t')})"
    longest = sql_longest(tokens, 6, 6)
    shapes = (
        f"list_filter([trim({claim}), CASE WHEN len({significant}) > 0 AND len({significant}) < len({tokens}) "
        f"THEN array_to_string(({significant})[1:12], ' ') END, "
        f"CASE WHEN len({longest}) >= 2 THEN array_to_string({longest}, ' ') END], lambda q: q IS NOT NULL)"
    )
    lowered = f"list_transform({shapes}, lambda q: lower(q))"
    return f"list_filter({shapes}, lambda q, i: list_position({lowered}, lower(q)) = i)"


def sql_bigrams(tokens: str) -> str:
    return (
        f"list_transform(list_zip(({tokens})[1:len({tokens}) - 1], ({tokens})[2:]), "
        f"lambda z: z[1]||' '||z[2])"
    )


# Non-ASCII letters as '_' so that the engine's ASCII word edges act like Unicode ones.
def sql_masked(text: str) -> str:
    return (
        f"regexp_replace({text}, '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}"
        f"\\x{{f8}}-\\x{{2c1}}]', '_', 'g')"
    )
