"""URL and HTML operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that track, public suffixes of two parts, named entities.
TRACKING = r"^(_ga|_gl|dclid|fbclid|gclid|gbraid|igshid|msclkid|twclid|wbraid|utm_.*|mc_.*|ss_.*|vero_.*)$"
SECOND_LEVEL = r"\.(com|org|net|edu|gov|co|ac)\.[a-z]{2}$"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, n)


def host(url: Column) -> Column:
    """The host in lower case, without credentials, port and final dots; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^[^@]*@|:\d*$", ""), r"\.+$", "")


def registrable_domain(url: Column) -> Column:
    """The domain that one registers: two labels, three under a public suffix of two."""
    h = host(url)
    three, two = F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    return F.when(h.rlike(SECOND_LEVEL), three).otherwise(F.when(two != "", two).otherwise(h))


def is_tracking(name: Column) -> Column:
    return F.lower(name).rlike(TRACKING)


def canonical_url(url: Column) -> Column:
    """A key for comparing URLs: scheme and host in lower case, no default port, fragment or tracking parameters, sorted query, no final slash; short video links in their long form. Without scheme and host only the fragment goes."""
    value = F.trim(url)
    scheme = F.lower(part(url, 1))
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    login = F.regexp_extract(part(url, 2), r"^([^@]*@)", 1)
    site = F.concat(login, host(url), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_replace(part(url, 3), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_replace(part(url, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, "^([^=]*)", 1)))
    query = F.array_join(F.array_sort(pairs), "&")
    short = host(url).isin("youtu.be", "www.youtu.be") & (path != "")
    watch = host(url).isin("youtube.com", "www.youtube.com", "m.youtube.com") & (part(url, 3) == "/watch")
    video = F.when(short, F.regexp_extract(path, "^/([^/]+)", 1)).when(watch, F.regexp_extract(query, "(?:^|&)v=([^&]+)", 1)).otherwise(F.lit(""))
    plain = F.concat(scheme, F.lit("://"), site, F.when(path == "", F.lit("/")).otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(part(url, 1) == "", F.regexp_replace(value, "#.*$", "")).when(video != "", F.concat(scheme, F.lit("://www.youtube.com/watch?v="), video)).otherwise(plain)


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Text of markup: breaks and paragraphs end lines, tags go, entities are read, blank lines collapse."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</h[1-6]>|</li>", "\n")
    out = unescape(F.regexp_replace(out, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(out, r"\n\s*\n+", "\n"))


def html_title(c: Column) -> Column:
    return unescape(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(c: Column) -> Column:
    return F.regexp_extract(c, r'(?i)<html[^>]*\blang="([^"]*)"', 1)


def meta(c: Column, name: str) -> Column:
    return F.regexp_extract(c, rf'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1)


def links(c: Column) -> Column:
    """Target and text of each anchor, in order."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("label"))
