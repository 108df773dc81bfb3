"""Scalar functions over urls, links and text, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.model import BrowserError, HttpError, InvalidQuery, NoEngines, ParseError, SearchTimeout, UrlError


def normalized_url(url: Column) -> Column:
    """Key of a page: repeated ``https://``, then ``http://`` prefixes and trailing slashes removed, lower case."""
    u = F.regexp_replace(url, "^(https://)+", "")
    u = F.regexp_replace(u, "^(http://)+", "")
    return F.lower(F.regexp_replace(u, r"/+\z", ""))


def strip_tags(html: Column) -> Column:
    """Text without tags; an unclosed tag drops the rest, a stray ``>`` is dropped, entities stay."""
    return F.regexp_replace(html, "<[^>]*>?|>", "")


def url_encode(text: Column) -> Column:
    """RFC 3986 percent-encoding of everything but letters, digits and ``-_.~``."""
    e = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` and stray ``%``; null where the bytes are not UTF-8."""
    x = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    out = F.try_url_decode(x)
    return F.when(F.contains(out, F.lit("�")) & ~F.contains(text, F.lit("�")), F.lit(None)).otherwise(out)


def redirect_target(url: Column) -> Column:
    """Target of a ``//duckduckgo.com/l/`` redirect; other urls are kept.

    The prefix up to ``uddg=`` is removed if it stands first, the whole rest decoded (kept
    raw if that isn't UTF-8) and then cut at the first ``&``.
    """
    rest = F.regexp_replace(url, r"^(//duckduckgo\.com/l/\?uddg=)+", "")
    target = F.substring_index(F.coalesce(percent_decode(rest), rest), "&", 1)
    return F.when(F.startswith(url, F.lit("//duckduckgo.com/l/")), target).otherwise(url)


def result_link(href: Column) -> Column:
    """Target of a ``/url?q=`` link, not decoded; null for other internal links but ``/url?``."""
    return (
        F.when(F.startswith(href, F.lit("/url?q=")), F.substring_index(F.substring(href, 8, 1 << 30), "&", 1))
        .when(F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit("/url?")), F.lit(None))
        .otherwise(href)
    )


def absolute_link(href: Column, host: str) -> Column:
    """``host`` in front of links that begin with a slash."""
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(host), href)).otherwise(href)


def preferred_link(first: Column, second: Column) -> Column:
    """The first attribute if it exists, even if empty; else the second; else empty."""
    return F.coalesce(first, second, F.lit(""))


def article_url(title: Column, page: str) -> Column:
    """Address of a title, put where {title} stands in ``page``; blanks become underscores, nothing is encoded."""
    before, after = page.split("{title}")
    return F.concat(F.lit(before), F.replace(title, F.lit(" "), F.lit("_")), F.lit(after))


def error_text(kind: Column, detail: Column) -> Column:
    """Message of an error by the name of its class; a null detail is empty."""
    text = F.lit(None).cast("string")
    for c in (HttpError, ParseError, SearchTimeout, NoEngines, InvalidQuery, UrlError, BrowserError):
        before, *after = c.template.split("{}")
        said = F.concat(F.lit(before), F.coalesce(detail, F.lit("")), F.lit(after[0])) if after else F.lit(before)
        text = F.when(kind == c.__name__, said).otherwise(text)
    return text


def truncate_bytes(text: Column, size: int) -> Column:
    """Characters that begin within the first ``size`` bytes, then ``...``; short text is kept."""
    whole = F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string"))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(F.left(text, F.length(whole)), F.lit("...")))


def is_blank(text: Column) -> Column:
    """Whether nothing but Unicode white space is in a text."""
    return F.regexp_replace(text, r"(?U)\s", "") == ""


def score_text(score: Column) -> Column:
    """Two places, rounded by the exact value of the double, a tie to the even digit."""
    x = F.abs(score)
    high = x.cast("float").cast("double")  # 200 times either part is exact
    n = F.floor(x * 100)
    over = lambda m: (high * 200 - (2 * m + 1)) + (x - high) * 200
    n = F.when(over(n) < -1, n - 1).otherwise(n)
    n = F.when((over(n) > 0) | ((over(n) == 0) & (n % 2 == 1)), n + 1).otherwise(n)
    sign = F.when(score < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(x < 1e12, text).otherwise(F.format_string("%.2f", score))


def proxy_url(protocol: Column, host: Column, port: Column, username: Column, password: Column) -> Column:
    """Address of a proxy; the credentials only if both are present."""
    auth = F.when(username.isNotNull() & password.isNotNull(), F.concat(username, F.lit(":"), password, F.lit("@"))).otherwise(F.lit(""))
    return F.concat(protocol, F.lit("://"), auth, host, F.lit(":"), port.cast("string"))
