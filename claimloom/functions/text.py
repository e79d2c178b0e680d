"""Text columns: whitespace, boundaries, sentences, tokens, language, markup, safety.

Patterns spell out Unicode letters, digits and spaces because Java's shorthand classes are
ASCII-only; every pattern here is free of per-row Python except :func:`nfkc`.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import vocab as V

WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
BEFORE_WORD = r"(?=[\p{L}\p{N}_])"
BENGALI = r"[\x{0980}-\x{09ff}]"
TOKEN = r"[\p{L}\p{N}_\x{0980}-\x{09ff}]+"
SENTENCE_GAP = rf"(?<=[.!?।]){WS}+"
MASK = "\ue000"

_ND = [chr(c) for c in range(sys.maxunicode) if c < 0x10000 and unicodedata.category(chr(c)) == "Nd"]
_ND_ASCII = "".join(str(unicodedata.digit(c)) for c in _ND)


def words_only(*alternatives: str) -> str:
    """A whole-word alternation.  A word that ends in a combining mark has its right edge only
    before a letter, which is how Unicode word boundaries treat marks."""
    ends_in_mark = [a for a in alternatives if unicodedata.category(a[-1]).startswith("M")]
    plain = [a for a in alternatives if a not in ends_in_mark]
    parts = []
    if plain:
        parts.append(f"(?:{'|'.join(plain)}){NOT_BEFORE_WORD}")
    if ends_in_mark:
        parts.append(f"(?:{'|'.join(ends_in_mark)}){BEFORE_WORD}")
    return f"(?iu){NOT_AFTER_WORD}(?:{'|'.join(parts)})"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return F.translate(c, "".join(_ND), _ND_ASCII)


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.  Without it the optimiser may inline the
    expression behind a column into a lambda and recompute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.  An inner explode of a computed array makes Spark compute the
    array a second time in a size filter; the outer form, with its null rows dropped, does not."""
    if position:
        rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.where(F.col(name).isNotNull())


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first of every group of items equal but for case, in order."""

    def firsts(held: Column) -> Column:
        kept = F.transform(F.array_distinct(held["low"]), lambda k: F.element_at(held["own"], F.array_position(held["low"], k).cast("int")))
        return F.when(held["own"].isNotNull(), kept)

    return bind(bind(items, lambda own: F.struct(own.alias("own"), F.transform(own, lambda x: F.lower(x)).alias("low"))), firsts)


# ---- normal form ---------------------------------------------------------------------

# Text made only of these characters, without the two listed sequences, is already NFKC.
_SETTLED = (
    r"\x00-\x7f\xc0-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
    r"\x{964}\x{965}\x{980}-\x{9db}\x{9de}\x{9e0}-\x{9ff}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{201e}\x{2020}-\x{2022}\x{20ac}\x{20b9}"
)
_UNSETTLED = rf"[^{_SETTLED}]|\x{{9c7}}[\x{{9be}}\x{{9d7}}]|\x{{9cd}}\x{{9bc}}"


@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """NFKC.  Spark has no such function; only rows that may change cross into Python, the rest
    travel as nulls."""
    # the first tests are cheap ones: ASCII text has as many bytes as characters, Western European text fails the second
    unsettled = (F.octet_length(c) != F.length(c)) & c.rlike(r"[^\x00-\x7f\xc0-\xff]") & c.rlike(_UNSETTLED)
    return F.coalesce(_nfkc_batch(F.when(unsettled, c)), c)


# ---- sentences -----------------------------------------------------------------------

_ABBREVIATION = "(?iu)" + "|".join(
    a.replace(".", r"\.") for a in V.ABBREVIATIONS if a != "est."  # "st." always matches first
)


def split_sentences(text: Column) -> Column:
    """Sentences after ``. ! ? ।`` and a space, with abbreviations and decimals protected.

    A protected abbreviation comes back in lower case and needs no left boundary.
    """
    pieces = F.split(text, _ABBREVIATION, -1)
    found = F.transform(find_all(text, _ABBREVIATION), lambda a: F.translate(F.lower(a), ".", MASK))
    masked = F.when(
        text.rlike(_ABBREVIATION),
        F.array_join(F.zip_with(pieces, found, lambda p, a: F.concat(p, F.coalesce(a, F.lit("")))), ""),
    ).otherwise(text)
    masked = F.regexp_replace(masked, r"(\p{Nd})\.(\p{Nd})", "$1" + MASK + "$2")
    parts = F.transform(
        F.split(masked, SENTENCE_GAP, -1), lambda p: strip(F.translate(p, MASK, "."))
    )
    return F.filter(parts, lambda p: p != "")


# ---- tokens --------------------------------------------------------------------------


def _stem_english(t: Column) -> Column:
    size = F.length(t)
    out = F.when(t.endswith("ies") & (size >= 7), F.concat(t.substr(F.lit(1), size - 3), F.lit("y")))
    for suffix in ("ing", "ed", "es", "s"):
        n = len(suffix)
        out = out.when(t.endswith(suffix) & (size >= n + 4), t.substr(F.lit(1), size - n))
    return out.otherwise(t)


def _stem_bengali(t: Column) -> Column:
    size = F.length(t)
    ordered = sorted(V.BENGALI_SUFFIXES, key=len, reverse=True)
    out = None
    for suffix in ordered:
        n = len(suffix)
        hit = t.endswith(suffix) & (size >= n + 3)
        cut = t.substr(F.lit(1), size - n)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


_STEMMED = "\ue001"
_TOKEN_CHAR = r"[\p{L}\p{N}_\x{0980}-\x{09ff}]"
# the ending is searched for and its word is then looked back at: few places are looked at closely.
# Looking back counts halves of characters: four letters are up to eight of them.
_IES = rf"ies(?!{_TOKEN_CHAR})(?<={_TOKEN_CHAR}{{4,8}}ies)"
_ENDING = "|".join(
    rf"{ending}(?![\ue001\p{{L}}\p{{N}}_\x{{0980}}-\x{{09ff}}])(?<={_TOKEN_CHAR}{{4,8}}{ending})" for ending in ("ing", "ed", "es", "s")
)


def tokenize(text: Column) -> Column:
    """Lower-cased, stop-word-free, lightly stemmed tokens of NFKC text, in text order.

    Text without Bengali is stemmed by two passes over the whole string, far cheaper than a
    lambda per token.  Stems carry a mark until stop words are gone, because a stem may spell a
    stop word and must stay.
    """
    prepared = F.lower(F.translate(text, V.BENGALI_DIGITS + _STEMMED, "0123456789"))
    bengali = prepared.rlike(BENGALI)
    marked = F.regexp_replace(
        F.regexp_replace(prepared, _IES, "y" + _STEMMED), _ENDING, _STEMMED
    )
    found = F.when(bengali, find_all(prepared, _TOKEN_CHAR + "{2,}")).otherwise(
        find_all(marked, _TOKEN_CHAR + "{2,}" + _STEMMED + "?")
    )
    stop = list(V.STOP_WORDS_EN + V.STOP_WORDS_BN)
    kept = F.filter(found, lambda t: ~t.isin(stop))
    latin = F.split(F.translate(F.array_join(kept, " "), _STEMMED, ""), " ")
    mixed = F.transform(
        kept, lambda t: F.when(t.rlike(BENGALI), _stem_bengali(t)).otherwise(_stem_english(t))
    )
    return F.when(bengali, mixed).otherwise(F.filter(latin, lambda t: t != ""))


def is_number_token(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def number_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, is_number_token))


def is_discriminating(t: Column) -> Column:
    return ((F.length(t) >= 6) | is_number_token(t)) & ~t.isin(list(V.LOW_INFORMATION))


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs, joined by a space (tokens hold none)."""
    following = F.slice(tokens, 2, 2**30)
    return F.array_compact(F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b)))


def longest_tokens(tokens: Column, min_len: int, k: int) -> Column:
    """The k longest distinct tokens of at least min_len, ties in text order."""
    distinct = F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= min_len))
    keyed = F.transform(
        distinct, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["t"])


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the tokens of a text column, normalised first."""
    return (
        df.withColumn("_normal", nfkc(F.col(text)))
        .withColumn(out, F.coalesce(tokenize(F.col("_normal")), F.array().cast("array<string>")))
        .drop("_normal")
    )


def build_queries(claim: Column, tokens: Column, max_queries: int = 4) -> Column:
    """Up to four distinct query strings: the claim, its content words, its longest words."""
    significant = F.filter(tokens, lambda t: (F.length(t) >= 4) | is_number_token(t))
    content = F.when(
        (F.size(significant) > 0) & (F.size(significant) < F.size(tokens)),
        F.array_join(F.slice(significant, 1, 12), " "),
    )
    longest = longest_tokens(tokens, 6, 6)
    rare = F.when(F.size(longest) >= 2, F.array_join(longest, " "))
    shapes = F.array_compact(F.array(F.nullif(strip(claim), F.lit("")), content, rare))
    return F.when(is_blank(claim), F.array().cast("array<string>")).otherwise(
        F.slice(distinct_ignoring_case(shapes), 1, max_queries)
    )


def site_query(claim: Column, tokens: Column) -> Column:
    """The search string for a publisher's own search box."""
    joined = F.array_join(longest_tokens(tokens, 4, 6), " ")
    return F.when(joined == "", claim.substr(1, 80)).otherwise(joined)


# ---- language ------------------------------------------------------------------------

SCRIPTS = {
    "latin": r"[\p{IsLatin}&&\p{L}]",
    "bengali": r"[\x{0980}-\x{09ff}&&\p{L}]",
    "devanagari": r"[\x{0900}-\x{097f}&&\p{L}]",
    "arabic": r"[\x{0600}-\x{06ff}&&\p{L}]",
    "cjk": r"[\x{4e00}-\x{9fff}&&\p{L}]",
    "cyrillic": r"[\x{0400}-\x{04ff}&&\p{L}]",
}
SCRIPT_SHARE = 0.15


def script_distribution(text: Column) -> Column:
    """Struct with the share of letters per script; zeros when there are no letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.struct(
        *[
            F.coalesce(F.try_divide(F.regexp_count(text, F.lit(p)), letters), F.lit(0.0)).alias(name)
            for name, p in SCRIPTS.items()
        ]
    )


def detect_language(text: Column, shares: Column) -> Column:
    """Struct(language, confidence, is_mixed) decided from :func:`script_distribution`."""
    enough = {n: shares[n] >= SCRIPT_SHARE for n in SCRIPTS}

    def found(code: str, share: Column) -> Column:
        return F.struct(F.lit(code).alias("language"), share.alias("confidence"))

    pick = F.when(
        enough["bengali"] & (shares["bengali"] >= shares["latin"]), found("bn", shares["bengali"])
    ).when(enough["latin"], found("en", shares["latin"]))
    for script, code in (("devanagari", "hi"), ("arabic", "ar"), ("cjk", "zh"), ("cyrillic", "ru")):
        pick = pick.when(enough[script], found(code, shares[script]))
    pick = pick.otherwise(found("en", F.lit(0.0)))
    mixed = sum((e.cast("int") for e in enough.values()), F.lit(0)) > 1
    blank = is_blank(text)
    return F.struct(
        F.when(blank, F.lit("en")).otherwise(pick["language"]).alias("language"),
        F.when(blank, F.lit(0.0)).otherwise(pick["confidence"]).alias("confidence"),
        F.when(blank, F.lit(False)).otherwise(mixed).alias("is_mixed"),
    )


def is_supported(language: Column) -> Column:
    return language.isin("en", "bn")


# ---- claims --------------------------------------------------------------------------


def normalize_claim(sentence: Column) -> Column:
    digits = F.translate(sentence, V.BENGALI_DIGITS, "0123456789")
    return F.rtrim(strip(F.regexp_replace(digits, WS + "+", " ")), F.lit(".!?।"))


# ---- hashes --------------------------------------------------------------------------


def body_hash(body: Column) -> Column:
    """SHA-256 of a body, null for an empty one."""
    return F.when(body != "", F.sha2(body, 256))


def submission_hash(*parts: Column) -> Column:
    cleaned = [F.lower(strip(F.coalesce(p, F.lit("")))) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *cleaned), 256)


def fingerprint(client: Column, salt: str) -> Column:
    """Salted hash of a client, the same for all that are unknown."""
    who = F.when(F.coalesce(client, F.lit("")) == "", F.lit("unknown")).otherwise(client)
    return F.sha2(F.concat(F.lit(salt + ":"), who), 256).substr(1, 32)


def is_public_id(value: Column, prefix: str | None = None) -> Column:
    letters = r"\p{L}{2,8}" if prefix is None else prefix
    shape = rf"^{letters}_[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{{8,32}}$"
    ok = value.rlike(shape)
    if prefix is not None and not (prefix.isalpha() and 2 <= len(prefix) <= 8):
        ok = F.lit(False)
    return F.coalesce(ok, F.lit(False))


# ---- markup --------------------------------------------------------------------------

_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decode_entities(text: Column) -> Column:
    """Named (HTML 4) and numeric character references as characters."""
    named = F.create_map(
        *[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))],
        F.lit("apos"), F.lit("'"),
    )

    def char(ref: Column) -> Column:
        code = F.when(
            ref.rlike("^#[xX]"), F.conv(ref.substr(F.lit(3), F.length(ref)), 16, 10)
        ).otherwise(ref.substr(F.lit(2), F.length(ref))).try_cast("int")
        numeric = F.when(
            (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        )
        return F.coalesce(
            F.when(ref.startswith("#"), numeric).otherwise(F.try_element_at(named, ref)),
            F.concat(F.lit("&"), ref, F.lit(";")),
        )

    decoded = F.array_join(
        F.zip_with(
            F.split(text, _ENTITY, -1),
            F.transform(find_all(text, _ENTITY, 1), char),
            lambda piece, c: F.concat(piece, F.coalesce(c, F.lit(""))),
        ),
        "",
    )
    return F.when(text.contains("&"), decoded).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Feed text without tags."""
    plain = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    return F.coalesce(strip(F.regexp_replace(plain, WS + "+", " ")), F.lit(""))


# ---- untrusted text ------------------------------------------------------------------

# Instruction-shaped phrasing, in reporting order.
INJECTION_PATTERNS = (
    r"\bignore\s+(all\s+|any\s+)?(your\s+|the\s+)?previous\s+instructions?\b",
    r"\bdisregard\s+(all\s+|any\s+)?(your\s+|the\s+)?(previous|prior|above)\b",
    r"\bforget\s+(everything|all)\b",
    r"\byou\s+are\s+now\s+(a|an)\b",
    r"\bnew\s+(system\s+)?(instructions?|prompt|rules?)\s*:",
    r"\b(system|assistant|user)\s*:\s*",
    r"<\s*/?\s*(system|instructions?|prompt)\s*>",
    r"\[/?INST\]|<\|im_(start|end)\|>|<\|endoftext\|>",
    r"\bmark\s+(this|it)\s+as\s+(true|verified|false)\b",
    r"\b(rule|classify|report)\s+(this|it)\s+(as\s+)?(true|verified|false)\b",
    r"\boverride\s+(your\s+)?(instructions?|rules?|verdict)\b",
    r"\bdo\s+not\s+(follow|obey)\s+",
)


def _unicode_pattern(pattern: str) -> str:
    """The same pattern with Unicode spaces and edges (each edge here touches an ASCII word)."""
    out = pattern.replace(r"\s", WS)
    if out.startswith(r"\b"):
        out = NOT_AFTER_WORD + out[2:]
    return "(?iu)" + out.replace(r"\b", NOT_BEFORE_WORD)


# What a text must hold for the pattern of that place to match: of each group one word, in lower case.
_NEEDED = (
    (("ignore",), ("previous",), ("instruction",)),
    (("disregard",), ("previous", "prior", "above")),
    (("forget",), ("everything", "all")),
    (("you",), ("are",), ("now",)),
    (("new",), ("instruction", "prompt", "rule"), (":",)),
    (("system", "assistant", "user"), (":",)),
    (("<",), ("system", "instruction", "prompt"), (">",)),
    (("[inst]", "[/inst]", "<|im_", "<|endoftext|>"),),
    (("mark",), ("true", "verified", "false")),
    (("rule", "classify", "report"), ("true", "verified", "false")),
    (("override",), ("instruction", "rule", "verdict")),
    (("not",), ("follow", "obey")),
)
# the characters beyond ASCII that a pattern takes for one of its letters, whatever their case
_LIKE_ASCII = ("\u017f\u0131\u0130\u212a", "siik")


def injection_signals(text: Column) -> Column:
    """The first match of every pattern, cut to 80 characters, distinct but for case.

    A pattern is only searched for where the text holds its words, which is far cheaper to see."""

    def hits(v: Column) -> Column:
        found = []
        for pattern, groups in zip(INJECTION_PATTERNS, _NEEDED, strict=True):
            held = [reduce(or_, [v["low"].contains(w) for w in words]) for words in groups]
            hit = F.when(reduce(and_, held), strip(F.regexp_extract(v["text"], _unicode_pattern(pattern), 0))).otherwise(F.lit(""))
            found.append(bind(hit, lambda h: F.when(F.length(h) > 80, F.concat(h.substr(1, 77), F.lit("..."))).otherwise(h)))
        return F.filter(F.array(*found), lambda h: h != "")

    low = F.lower(F.translate(text, *_LIKE_ASCII))
    return distinct_ignoring_case(bind(F.struct(text.alias("text"), low.alias("low")), hits))


# Bidirectional controls, zero-width characters, the escape character.
_DECEPTIVE = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200b}-\x{200d}\x{feff}\x1b]"
_FENCE = r"<{2,}[^\n>]{0,80}>{2,}"


def sanitize(text: Column, max_chars: int | None = None) -> Column:
    """Struct(text, truncated): NFKC text that can no longer disguise its own structure."""
    clean = F.regexp_replace(text, _DECEPTIVE, "")
    fences = F.transform(find_all(clean, _FENCE), lambda m: F.translate(m, "<>", "﹤﹥"))
    refenced = F.array_join(
        F.zip_with(
            F.split(clean, _FENCE, -1), fences, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))
        ),
        "",
    )
    clean = F.when(clean.rlike(_FENCE), refenced).otherwise(clean)
    clean = F.regexp_replace(clean, r"[\p{C}&&[^\n\r\t]]", "")
    clean = F.regexp_replace(clean, r"\n{4,}", "\n\n\n")
    clean = F.coalesce(F.regexp_replace(clean, r"[ \t]{8,}", "    "), F.lit(""))
    cut = F.lit(False) if max_chars is None else F.length(clean) > max_chars
    kept = clean if max_chars is None else clean.substr(1, max_chars)
    return F.struct(strip(kept).alias("text"), cut.alias("truncated"))
