"""Figures and claim traits: money, percentages, numbers, dates, entities, type, importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions.text import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    WORD,
    WS,
    ascii_digits,
    bind,
    distinct_ignoring_case,
    find_all,
    strip,
    words_only,
)

EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Currency marks, scale words, percent words, months, markers.
_CURRENCY = rf"(?:[$€£¥₹৳]|{NOT_AFTER_WORD}(?:USD|EUR|GBP|BDT|INR|JPY){NOT_BEFORE_WORD})"
_AMOUNT = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
MONEY = (
    rf"(?iu)({_CURRENCY}){WS}*({_AMOUNT}){WS}*"
    r"(billion|million|trillion|thousand|bn|mn|k|crore|lakh)?"
)
_PERCENT = rf"(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*(?:%|percent|per cent|শতাংশ)"
PERCENT = "(?iu)" + _PERCENT
# group 1: a currency just before; group 2: the number opens a percentage
NUMBER = (
    rf"(?iu)({_CURRENCY}{WS}*)?{NOT_AFTER_WORD}(?=({_PERCENT})?)({_AMOUNT}){WS}*"
    rf"(billion|million|trillion|thousand|bn|mn|crore|lakh)?{EDGE}"
)
# the numbers of NUMBER without what stands before them; digits are tried first, which few characters are
PLAIN = (
    rf"\p{{Nd}}(?<!{WORD}\p{{Nd}})[\p{{Nd}},]*(?:\.\p{{Nd}}+)?{WS}*"
    rf"(?iu:billion|million|trillion|thousand|bn|mn|crore|lakh)?{EDGE}"
)
_MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
)
DATES = (
    rf"{NOT_AFTER_WORD}\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}{NOT_BEFORE_WORD}",
    rf"(?iu){NOT_AFTER_WORD}\p{{Nd}}{{1,2}}{WS}+{_MONTH}{WS}+\p{{Nd}}{{4}}{NOT_BEFORE_WORD}",
    rf"(?iu){NOT_AFTER_WORD}{_MONTH}{WS}+\p{{Nd}}{{1,2}},?{WS}+\p{{Nd}}{{4}}{NOT_BEFORE_WORD}",
)
RELATIVE = words_only(
    "today", "yesterday", "tomorrow", "this (?:morning|afternoon|evening|week|month|year)",
    "last (?:night|week|month|year)", "next (?:week|month|year)", "just now", "moments ago",
    "আজ", "গতকাল", "আগামীকাল", "এই সপ্তাহে", "গত সপ্তাহে",
)
YEAR = rf"{NOT_AFTER_WORD}(?:1[89]\p{{Nd}}{{2}}|20\p{{Nd}}{{2}}){NOT_BEFORE_WORD}"
_NAME = rf"[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{NOT_BEFORE_WORD}"
ENTITY = NOT_AFTER_WORD + _NAME

OPINION = words_only(
    "i think", "i believe", "in my opinion", "arguably", "should", "ought to", "best", "worst",
    "beautiful", "ugly", "terrible", "wonderful", "deserve", "hopefully", "probably will",
)
PREDICTION = words_only(
    "will", "going to", "expected to", "forecast", "predicted", r"by \p{Nd}{4}", "next year", "soon"
)
QUOTE = r'"[^"]{10,}"|“[^”]{10,}”'
ATTRIBUTION = words_only(
    "said", "says", "according to", "reported", "claimed", "stated", "announced", "told",
    "বলেছেন", "জানিয়েছে", "অনুযায়ী",
)
CAUSAL = words_only("because", "due to", "caused by", "led to", "resulted in")
CASUALTY = words_only(
    "killed", "died", "deaths", "casualties", "injured", "arrested", "banned", "approved"
)


def _value(amount: Column, scale: Column) -> Column:
    plain = ascii_digits(F.replace(amount, F.lit(","), F.lit(""))).try_cast("double")
    factor = F.lit(1.0)
    for word, times in V.SCALES.items():
        factor = F.when(F.lower(scale) == word, F.lit(float(times))).otherwise(factor)
    return plain * factor


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _zipped(**arrays: Column) -> Column:
    return F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])


def _where_digits(text: Column, items: Column) -> Column:
    """Skip the pattern work for text without a digit."""
    return F.when(text.rlike(r"\p{Nd}"), items).otherwise(F.filter(items, lambda _: F.lit(False)))


def extract_money(text: Column) -> Column:
    """array<struct(raw, currency, value, scale)> in text order."""
    parts = F.arrays_zip(
        find_all(text, MONEY), find_all(text, MONEY, 1), find_all(text, MONEY, 2), find_all(text, MONEY, 3)
    )
    items = F.transform(
        parts,
        lambda p: F.struct(
            strip(p["0"]).alias("raw"),
            p["1"].alias("currency"),
            _value(p["2"], p["3"]).alias("value"),
            _none_if_empty(p["3"]).alias("scale"),
        ),
    )
    return F.filter(items, lambda m: m["value"].isNotNull())


def extract_percentages(text: Column) -> Column:
    """array<struct(raw, value)> in text order."""
    parts = F.arrays_zip(find_all(text, PERCENT), find_all(text, PERCENT, 1))
    items = F.transform(
        parts,
        lambda p: F.struct(
            strip(p["0"]).alias("raw"), ascii_digits(p["1"]).try_cast("double").alias("value")
        ),
    )
    return F.filter(items, lambda m: m["value"].isNotNull())


def extract_numbers(text: Column, exclude_money_and_percent: bool = True) -> Column:
    """array<struct(raw, value, scale)>; unscaled whole numbers 1900..2100 are taken for years.

    A number is inside a money span when a currency stands right before it, and inside a
    percent span when the text from its first digit reads as a percentage; both are captured
    by the one pattern, so no offsets are needed.
    """
    parts = F.arrays_zip(
        find_all(text, NUMBER),
        find_all(text, NUMBER, 1),
        find_all(text, NUMBER, 2),
        find_all(text, NUMBER, 4),
        find_all(text, NUMBER, 5),
    )
    items = F.transform(
        parts,
        lambda p: F.struct(
            strip(p["0"].substr(F.length(p["1"]) + 1, F.length(p["0"]))).alias("raw"),
            _value(p["3"], p["4"]).alias("value"),
            _none_if_empty(p["4"]).alias("scale"),
            ((p["1"] != "") | (p["2"] != "")).alias("claimed"),
            p["3"].contains(".").alias("dotted"),
        ),
    )

    def keep(n: Column) -> Column:
        year = n["value"].between(1900, 2100) & n["scale"].isNull() & ~n["dotted"]
        ok = n["value"].isNotNull() & ~year
        return ok & ~n["claimed"] if exclude_money_and_percent else ok

    return F.transform(
        F.filter(items, keep),
        lambda n: F.struct(n["raw"].alias("raw"), n["value"].alias("value"), n["scale"].alias("scale")),
    )


def extract_dates(text: Column) -> Column:
    """array<struct(raw, type, value)>: absolute, then relative, then years not yet covered."""

    def tagged(items: Column, kind: str) -> Column:
        return F.transform(
            items,
            lambda r: F.struct(
                r.alias("raw"), F.lit(kind).alias("type"), F.lit(None).cast("int").alias("value")
            ),
        )

    def years(so_far: Column, found: Column) -> Column:
        return F.concat(
            so_far,
            F.transform(
                F.filter(found, lambda y: ~F.exists(so_far, lambda d: F.contains(d["raw"], y))),
                lambda y: F.struct(
                    y.alias("raw"), F.lit("year").alias("type"), ascii_digits(y).cast("int").alias("value")
                ),
            ),
        )

    named = F.concat(
        *[tagged(find_all(text, p), "absolute") for p in DATES], tagged(find_all(text, RELATIVE), "relative")
    )
    return bind(
        F.struct(named.alias("named"), F.array_distinct(find_all(text, YEAR)).alias("found")),
        lambda s: years(s["named"], s["found"]),
    )


def extract_entities(text: Column) -> Column:
    """array<string>: runs of capitalised words, without a lone sentence-opening word."""
    opens = text.rlike("^" + _NAME)
    kept = F.filter(
        find_all(text, ENTITY),
        lambda e, i: ~(opens & (i == 0) & ~e.contains(" ")) & (F.length(e) >= 3),
    )
    return distinct_ignoring_case(kept)


def has_figure(text: Column) -> Column:
    return text.rlike(MONEY) | text.rlike(PERCENT)


def has_date(text: Column) -> Column:
    return text.rlike(RELATIVE) | (
        text.rlike(r"\p{Nd}") & (text.rlike(DATES[0]) | text.rlike(DATES[1]) | text.rlike(DATES[2]))
    )


def claim_type(sentence: Column, figure: Column, dated: Column) -> Column:
    return (
        F.when(sentence.rlike(OPINION), "OPINION")
        .when(sentence.rlike(PREDICTION), "PREDICTION")
        .when(sentence.rlike(QUOTE), "QUOTE")
        .when(sentence.rlike(ATTRIBUTION), "ATTRIBUTION")
        .when(figure, "STATISTIC")
        .when(sentence.rlike(CAUSAL), "CAUSAL")
        .when(dated, "EVENT")
        .otherwise("OTHER")
    )


def importance(sentence: Column, position: Column, kind: Column, figure: Column, dated: Column) -> Column:
    score = (
        F.lit(0.5)
        + F.when(position == 0, 0.25).when(position < 3, 0.1).otherwise(0.0)
        + F.when(figure, 0.15).otherwise(0.0)
        + F.when(dated, 0.1).otherwise(0.0)
        + F.when(sentence.rlike(CASUALTY), 0.15).otherwise(0.0)
        - F.when(kind.isin(*V.UNCHECKABLE_CLAIM_TYPES), 0.3).otherwise(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), score))


# ---- comparing figures ---------------------------------------------------------------


def _figures(raws: Column) -> Column:
    """array<struct(value, scale, dotted)> of found amounts, each with what stands before and after it."""

    def parsed(raw: Column) -> Column:
        amount, scale = F.regexp_extract(raw, r"\p{Nd}[\p{Nd},.]*", 0), F.regexp_extract(raw, r"\p{L}+$", 0)
        return F.struct(amount.alias("amount"), scale.alias("scale"))

    def valued(p: Column) -> Column:
        value = F.when(p["scale"] == "", _value(p["amount"], F.lit(""))).otherwise(_value(p["amount"], p["scale"]))
        return F.struct(value.alias("value"), p["scale"].alias("scale"), p["amount"].contains(".").alias("dotted"))

    return F.transform(F.transform(raws, parsed), valued)


def figure_values(text: Column) -> Column:
    """Every distinct plain and money value in the text.

    The text is read once per pattern; amounts and scales are taken off the short matches."""

    def plain(n: Column) -> Column:
        return n["value"].isNotNull() & ~(n["value"].between(1900, 2100) & (n["scale"] == "") & ~n["dotted"])

    return F.array_distinct(
        F.concat(
            F.transform(F.filter(_figures(find_all(text, PLAIN)), plain), lambda n: n["value"]),
            F.transform(F.filter(_figures(find_all(text, MONEY)), lambda m: m["value"].isNotNull()), lambda m: m["value"]),
        )
    )


def without_years(values: Column) -> Column:
    return F.filter(values, lambda v: ~(v.between(1900, 2100) & (F.floor(v) == v)))


def comparable_numbers(text: Column) -> Column:
    return without_years(figure_values(text))


def general_format(x: Column) -> Column:
    """A double in six significant digits, trailing zeros dropped, like C's ``%g``."""
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    rounded = F.bround(x / F.pow(F.lit(10.0), exponent), 5)
    carry = F.abs(rounded) >= 10
    exponent = F.when(carry, exponent + 1).otherwise(exponent)
    mantissa = F.when(carry, rounded / 10).otherwise(rounded)

    def trimmed(s: Column) -> Column:
        return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)

    scientific = F.concat(
        trimmed(F.format_string("%.5f", mantissa)),
        F.lit("e"),
        F.when(exponent < 0, "-").otherwise("+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    decimals = F.greatest(F.lit(0), F.lit(5) - exponent)
    fixed = trimmed(F.format_string("%.10f", F.bround(x * F.pow(F.lit(10.0), decimals), 0) / F.pow(F.lit(10.0), decimals)))
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= 6), scientific).otherwise(fixed)


def numeric_conflict(claim_values: Column, passage_values: Column) -> Column:
    """Struct(conflict, claim_value, passage_value) over two arrays of comparable numbers.

    A claim value conflicts when no passage value lies within 2 % of it and some passage value
    differs by a factor of 1.5 to 20.  The first conflicting pair is reported.
    """

    def rivals(c: Column, others: Column) -> Column:
        return F.filter(
            others,
            lambda p: (p != 0)
            & F.try_divide(F.greatest(c, p), F.least(c, p)).between(1.5, 20.0),
        )

    def corroborated(c: Column, others: Column) -> Column:
        return F.exists(
            others, lambda p: F.abs(c - p) / F.greatest(F.abs(c), F.lit(1.0)) <= 0.02
        )

    def first_pair(v: Column) -> Column:
        pairs = F.transform(
            F.filter(v["c"], lambda c: (c != 0) & ~corroborated(c, v["p"])),
            lambda c: F.struct(c.alias("claim"), F.get(rivals(c, v["p"]), F.lit(0)).alias("passage")),
        )
        return F.get(F.filter(pairs, lambda p: p["passage"].isNotNull()), F.lit(0))

    found = bind(F.struct(claim_values.alias("c"), passage_values.alias("p")), first_pair)
    return bind(
        found,
        lambda f: F.struct(
            f.isNotNull().alias("conflict"),
            f["claim"].alias("claim_value"),
            f["passage"].alias("passage_value"),
        ),
    )
