"""What article pages tell about themselves, and redirecting links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import distinct_by_key, strip
from .urls import unescape

_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
#: Types of linked data that describe an article.
ARTICLES = ("Article", "NewsArticle", "ReportageNewsArticle", "BlogPosting", "OpinionNewsArticle", "AnalysisNewsArticle")


def linked_data(html: Column) -> Column:
    """The JSON-LD objects of a page as variants: blocks, the members of their @graph, and of blocks that are arrays. Blocks that don't parse are left out."""
    blocks = F.filter(F.transform(F.regexp_extract_all(html, F.lit(_LD), F.lit(1)), F.try_parse_json), lambda v: v.isNotNull())
    members = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(blocks, lambda v: F.concat(F.array(v), members(v, "$['@graph']"), members(v, "$"))))


def _texts(v: Column, path: str) -> Column:
    one = F.try_variant_get(v, path, "string")
    return F.when(one.isNotNull() & ~F.startswith(one, F.lit("{")) & ~F.startswith(one, F.lit("[")), F.array(one)).otherwise(F.array().cast("array<string>"))


def article_authors(html: Column) -> Column:
    """Names of the authors that the linked data of an article gives: as text, an object, a list, or a reference by @id."""
    nodes = linked_data(html)
    get = lambda v, path: F.try_variant_get(v, path, "string")
    articles = F.filter(nodes, lambda v: get(v, "$['@type']").isin(*ARTICLES))
    several = lambda v: F.coalesce(F.try_variant_get(v, "$.author", "array<variant>"), F.array().cast("array<variant>"))
    named = lambda a: F.concat(_texts(a, "$"), _texts(a, "$.name"))
    known = lambda key: F.transform(F.filter(nodes, lambda n: (get(n, "$['@id']") == key) & get(n, "$.name").isNotNull()), lambda n: get(n, "$.name"))
    referred = lambda a: F.flatten(F.transform(_texts(a, "$['@id']"), known))
    of = lambda v: F.concat(_texts(v, "$.author"), _texts(v, "$.author.name"), F.flatten(F.transform(several(v), named)), F.flatten(F.transform(_texts(v, "$.author['@id']"), known)), F.flatten(F.transform(several(v), referred)))
    return distinct_by_key(F.filter(F.transform(F.flatten(F.transform(articles, of)), lambda x: strip(unescape(x))), lambda x: x != ""), F.lower)


def publication_date(html: Column) -> Column:
    """The first ISO date of: linked data of an article, the usual meta elements, a time element."""
    articles = F.filter(linked_data(html), lambda v: F.try_variant_get(v, "$['@type']", "string").isin(*ARTICLES))
    told = F.transform(articles, lambda v: F.try_variant_get(v, "$.datePublished", "string"))
    attribute = lambda tag, key, value: F.regexp_extract(html, rf'(?i)<{tag}[^>]*{key}[^>]*\b{value}="([^"]*)"', 1)
    metas = [attribute("meta", 'property="article:published_time"', "content"), attribute("meta", 'name="date"', "content"), attribute("meta", 'name="pubdate"', "content"), F.regexp_extract(html, r'(?i)<time[^>]*\bdatetime="([^"]*)"', 1)]
    dates = F.transform(F.concat(told, F.array(*metas)), lambda x: F.regexp_extract(x, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1))
    return F.get(F.filter(dates, lambda d: d != ""), F.lit(0)).try_cast("date")


def embedded_target(url: Column) -> Column:
    """The link that a redirect carries in its last path part, as URL-safe base64; null if there is none."""
    token = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+)$", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    plain = F.try_to_binary(F.when(padded.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), padded), F.lit("base64")).cast("string")
    return F.when(plain.rlike(r"^https?://[^/\s]+"), plain)


def complete_objects(raw: Column) -> Column:
    """A truncated JSON array up to its last whole object, closed; null if it holds none."""
    prefix = F.regexp_extract(raw, r"(?s)(\[.*\})", 1)
    return F.when(prefix != "", F.concat(F.regexp_replace(prefix, r"(?s)^[^\[]*", ""), F.lit("]")))


def fenced_json(raw: Column) -> Column:
    """The JSON inside a model's answer: without code fences and what stands around the outermost braces or brackets."""
    bare = F.regexp_replace(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", "$1")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
