"""Web columns: hosts, registry suffixes, URL safety audit, page text and links."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import vocab as V
from claimloom.functions.text import bind, decode_entities, find_all, strip

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def raw_host(url: Column) -> Column:
    """The host part as written, lower case, without credentials, port or brackets."""
    place = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    return F.lower(F.regexp_extract(place, r"^(?:\[([^\]]*)\]|([^:]*))", 0))


def host(url: Column) -> Column:
    """Host of a URL, lower case, without a leading ``www.``; '' when there is none."""
    bare = F.regexp_replace(F.coalesce(raw_host(url), F.lit("")), r"[\[\]]", "")
    return F.regexp_replace(bare, r"^www\.", "")


def dedup_key(canonical: Column, url: Column) -> Column:
    return F.lower(F.rtrim(F.coalesce(F.nullif(canonical, F.lit("")), url), F.lit("/")))


def domain_suffixes(domain: Column) -> Column:
    """Every dotted suffix of a domain, longest first."""
    parts = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def is_social_host(domain: Column) -> Column:
    bare = F.regexp_replace(F.lower(domain), r"^www\.", "")
    names = "|".join(h.replace(".", r"\.") for h in V.SOCIAL_HOSTS)
    return F.coalesce(bare.rlike(rf"^(?:.*\.)?(?:{names})$"), F.lit(False))


# ---- URL safety ----------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _punycode(s: pd.Series) -> pd.Series:
    def encode(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            return v.encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    return s.map(encode)


@F.pandas_udf(T.StringType())
def _ipv6_class(s: pd.Series) -> pd.Series:
    """'' for a public address, a class for a blocked one, null for no address at all."""

    def classify(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            ip = ipaddress.ip_address(v)
        except ValueError:
            return None
        if isinstance(ip, ipaddress.IPv6Address):
            inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo[1] if ip.teredo else None)
            ip = inner or ip
        for name in ("loopback", "link_local", "multicast", "unspecified", "reserved", "private"):
            if getattr(ip, f"is_{name}"):
                return name
        if any(ip in ipaddress.ip_network(n) for n in V.BLOCKED_IPV4 if ip.version == 4):
            return "blocked_range"
        return "" if ip.is_global else "not_globally_routable"

    return s.map(classify)


def _number_part(p: Column) -> Column:
    """One part of an address: decimal, 0x-hexadecimal or 0-octal; null if none of them."""
    hexa = F.when(
        p.rlike("^0x[0-9a-f]{1,12}$"), F.conv(p.substr(F.lit(3), F.length(p)), 16, 10)
    )
    octal = F.when(p.rlike("^0[0-7]{1,15}$"), F.conv(p, 8, 10))
    decimal = F.when(p.rlike("^(0|[1-9][0-9]{0,14})$"), p)
    return F.coalesce(hexa, octal, decimal).try_cast("long")


def ipv4_value(name: Column) -> Column:
    """An IPv4 literal in any spelling (dotted, short, decimal, hex, octal) as a number."""

    def packed(parts: Column) -> Column:
        n = F.size(parts)
        leading = F.aggregate(
            F.slice(parts, 1, F.greatest(n - 1, F.lit(0))),
            F.lit(0).cast("long"),
            lambda acc, v: F.when((acc >= 0) & v.between(0, 255), acc * 256 + v).otherwise(F.lit(-1)),
        )
        # the last part fills whatever room is left: 127.1 is 127.0.0.1
        room = F.pow(F.lit(256.0), 5 - n).cast("long")
        return bind(
            F.struct(leading.alias("lead"), F.element_at(parts, -1).alias("last"), room.alias("room"), n.alias("n")),
            lambda v: F.when(
                v["n"].between(1, 4) & (v["lead"] >= 0) & (v["last"] >= 0) & (v["last"] < v["room"]),
                v["lead"] * v["room"] + v["last"],
            ),
        )

    # a lone run of digits is decimal even with a leading zero
    whole = F.when(name.rlike("^[0-9]{1,18}$"), name.try_cast("long"))
    value = F.when(name.rlike("^0[0-9]+$"), F.when(whole < 2**32, whole)).otherwise(
        bind(F.transform(F.split(name, r"\."), _number_part), packed)
    )
    return F.when(name.rlike("^[0-9a-fx.]+$"), value)


def ipv4_class(value: Column) -> Column:
    """'' for a public IPv4 number, else why it is blocked."""
    return bind(value, _ipv4_class)


def _ipv4_class(value: Column) -> Column:
    # The ranges.

    def inside(*blocks: str) -> Column:
        test = F.lit(False)
        for block in blocks:
            net = ipaddress.ip_network(block)
            test = test | value.between(int(net.network_address), int(net.broadcast_address))
        return test

    private = (
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
        "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    )
    return (
        F.when(inside("127.0.0.0/8"), "loopback")
        .when(inside("169.254.0.0/16"), "link_local")
        .when(inside("224.0.0.0/4"), "multicast")
        .when(value == 0, "unspecified")
        .when(inside("240.0.0.0/4"), "reserved")
        .when(inside(*private) & ~inside("192.0.0.9/32", "192.0.0.10/32"), "private")
        .when(inside(*V.BLOCKED_IPV4), "blocked_range")
        .when(value.isNotNull(), "")
    )


def url_audit(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add reject_reason (null when the URL is acceptable), host, port and address_class."""
    url = strip(F.coalesce(F.col(url_col), F.lit("")))
    authority = F.regexp_extract(F.col("_url"), _AUTHORITY, 1)
    user = F.when(F.col("_auth").contains("@"), F.regexp_extract(F.col("_auth"), "^(.*)@", 1))
    place = F.regexp_replace(F.col("_auth"), "^.*@", "")
    steps = (
        df.withColumn("_url", url)
        .withColumn("_auth", authority)
        .withColumn("_user", F.coalesce(user, F.lit("")))
        .withColumn("_place", place)
        .withColumn("_scheme", F.lower(F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
        .withColumn(
            "_name",
            F.lower(
                F.when(F.col("_place").startswith("["), F.regexp_extract("_place", r"^\[([^\]]*)\]", 1))
                .otherwise(F.regexp_extract("_place", "^[^:]*", 0))
            ),
        )
        .withColumn(
            "_port",
            F.when(F.col("_place").startswith("["), F.regexp_extract("_place", r"^\[[^\]]*\]:(.*)$", 1))
            .otherwise(F.regexp_extract("_place", "^[^:]*:(.*)$", 1)),
        )
        .withColumn("_trimmed", F.rtrim(strip(F.col("_name")), F.lit(".")))
        .withColumn(
            "_host",
            F.coalesce(
                _punycode(F.when(F.col("_trimmed").rlike(r"[^\x00-\x7f]"), F.col("_trimmed"))),
                F.col("_trimmed"),
            ),
        )
        .withColumn("_v4", ipv4_value(F.col("_host")))
        .withColumn(
            "address_class",
            F.coalesce(
                ipv4_class(F.col("_v4")),
                _ipv6_class(F.when(F.col("_host").contains(":"), F.col("_host"))),
            ),
        )
        .withColumn("_port_no", F.when(F.col("_port").rlike("^[0-9]{1,9}$"), F.col("_port")).try_cast("int"))
        .withColumn(
            "port",
            F.when(F.coalesce(F.col("_port_no"), F.lit(0)) > 0, F.col("_port_no")).otherwise(
                F.when(F.col("_scheme") == "https", 443).otherwise(80)
            ),
        )
    )
    h = F.col("_host")
    internal = F.lit(False)
    for suffix in V.BLOCKED_SUFFIXES:
        internal = internal | h.endswith(suffix)
    brackets = F.col("_place").contains("[") != F.col("_place").contains("]")
    reason = (
        F.when(F.col("_url") == "", "empty_url")
        .when(F.length("_url") > V.MAX_URL, "url_too_long")
        .when(F.col("_url").rlike(r"[\x00-\x1f\x7f]"), "control_characters")
        .when(F.col("_url").contains("\\"), "backslash")
        .when(brackets, "unparseable")
        .when(~F.col("_scheme").isin("http", "https"), "bad_scheme")
        .when(F.regexp_replace("_user", "^:$", "") != "", "credentials_in_url")
        .when(F.col("_name") == "", "no_host")
        .when(F.col("_trimmed") == "", "empty_host")
        .when(h == "", "invalid_hostname")
        .when(F.length(h) > V.MAX_HOST, "hostname_too_long")
        .when(~h.rlike("^[A-Za-z0-9._:-]*$"), "invalid_hostname_chars")
        .when(
            (F.col("_port") != "") & (F.col("_port_no").isNull() | (F.col("_port_no") > 65535)), "bad_port"
        )
        .when(~F.col("port").isin(*V.ALLOWED_PORTS), "blocked_port")
        .when(h.isin(*V.BLOCKED_HOSTS), "blocked_hostname")
        .when(internal, "blocked_hostname_suffix")
        .when(F.col("address_class").isNull() & ~h.contains("."), "bare_hostname")
        .when(F.col("address_class") != "", "blocked_ip_literal")
    )
    dotted = F.concat_ws(
        ".", *[(F.shiftright("_v4", 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)]
    )
    return (
        steps.withColumn("reject_reason", reason)
        .withColumn("host", F.when(F.col("_v4").isNotNull(), dotted).otherwise(h))
        .drop(*[c for c in steps.columns if c.startswith("_")])
    )


# ---- pages ---------------------------------------------------------------------------

_DROPPED = "script style nav header footer aside form".split()


def _without_chrome(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in _DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def _pieces(fragment: Column) -> Column:
    """The text between tags, decoded and trimmed, without the empty pieces."""
    return F.filter(
        F.transform(F.split(fragment, "(?s)<[^>]*>", -1), lambda t: strip(decode_entities(t))),
        lambda t: t != "",
    )


def _plain(fragment: Column) -> Column:
    return F.array_join(_pieces(fragment), " ")


# A paragraph ends at its closing tag, at the next paragraph, or where its container ends.
_PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)(?=<p[\s>]|</p\s*>|</article\s*>|</body\s*>|$)"


def article_columns(html: Column) -> dict[str, Column]:
    """title, canonical_url and the list of paragraphs of a page."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel=["']?canonical["']?[^>]*>""", 0)
    href = F.regexp_extract(link, r"""(?is)\bhref=["']?([^"'\s>]+)""", 1)
    return {
        "title": F.nullif(_plain(title), F.lit("")),
        "canonical_url": F.nullif(href, F.lit("")),
        "paragraphs": find_all(_without_chrome(html), _PARAGRAPH, 1),
    }


def article_text(paragraphs: Column, max_chars: int | None = V.MAX_ARTICLE_CHARS) -> Column:
    """Paragraph texts longer than 40 characters, a blank line between them, cut to max_chars; None cuts nothing."""
    split = F.transform(paragraphs, _pieces)
    texts = F.transform(
        F.filter(split, lambda t: F.length(F.array_join(t, "")) > 40), lambda t: F.array_join(t, " ")
    )
    body = F.array_join(texts, "\n\n")
    return F.nullif(body if max_chars is None else body.substr(1, max_chars), F.lit(""))


# Path words that mark navigation.
NAVIGATION = (
    r"(?i)/(search|tag|topic|author|category|page|login|subscribe|privacy|terms|about)(/|$|\?)"
)
ANCHOR = r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def absolute_url(href: Column, domain: Column) -> Column:
    """href joined to ``https://www.{domain}``."""
    base = F.concat(F.lit("https://www."), domain)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .when(href == "", base)
        .when(href.rlike(r"^[?#]"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), href))
    )


def anchor_text(fragment: Column) -> Column:
    return _plain(fragment)
