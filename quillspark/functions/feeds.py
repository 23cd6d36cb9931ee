"""Feeds as column expressions: their addresses, their entries from RSS, Atom and JSON, their dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import lookup
from .text import strip
from .urls import strip_html

#: Kinds of feed that have an address of their own, where a channel's feed lies, months in mail dates, names of zone zero.
PLAIN_KINDS = ("rss", "wordpress", "json_api")
CHANNEL_FEED = "https://www.youtube.com/feeds/videos.xml?channel_id="
MAIL_MONTHS = {name: f"{k:02d}" for k, name in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
ZERO = ("GMT", "UT", "UTC", "Z")
_RSS = "channel struct<item array<struct<title string, link string, pubDate string, description string>>>"
_ATOM = "entry array<struct<title string, link array<struct<_href string>>, published string, group struct<description string>>>"
ENTRY = "array<struct<title:string,url:string,published:string,summary:string>>"


def feed_url(kind: Column, url: Column, channel: Column) -> Column:
    """Where a feed is read; null for an unknown kind."""
    return F.when(kind == "youtube_channel", F.concat(F.lit(CHANNEL_FEED), channel)).when(kind.isin(*PLAIN_KINDS), url)


def mail_date(c: Column) -> Column:
    """A date of RFC 2822 in ISO form, with its offset; null for anything else."""
    pattern = r"^(?:[A-Za-z]{3}, *)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(:\d{2})? ([A-Za-z]{1,3}|[+-]\d{4})$"
    part = lambda g: F.regexp_extract(strip(c), pattern, g)
    zone = F.when(F.upper(part(6)).isin(*ZERO), "+00:00").when(part(6).rlike(r"^[+-]\d{4}$"), F.concat(F.left(part(6), F.lit(3)), F.lit(":"), F.right(part(6), F.lit(2))))
    local = F.concat(part(3), F.lit("-"), lookup(F.lower(part(2)), MAIL_MONTHS), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), F.when(part(5) != "", part(5)).otherwise(":00"))
    return F.when(local.try_cast("timestamp_ntz").isNotNull(), F.concat(local, zone))


def published_at(c: Column) -> Column:
    """An instant from an ISO or mail date; null for anything else. A date without an offset is in the session's zone."""
    iso = F.when(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}"), strip(c))
    return F.coalesce(iso, mail_date(c)).try_cast("timestamp")


def _entry(title: Column, url: Column, published: Column, summary: Column) -> Column:
    text = lambda x: strip(F.coalesce(x, F.lit("")))
    return F.struct(text(title).alias("title"), text(url).alias("url"), text(published).alias("published"), text(summary).alias("summary"))


def _all(entries: Column) -> Column:
    return F.coalesce(entries, F.array().cast(ENTRY))


def rss_entries(xml: Column) -> Column:
    """title, url, published (ISO where it can be read), summary of each item; none where there is no channel."""
    items = F.from_xml(xml, _RSS, {"ignoreNamespace": "true"})["channel"]["item"]
    return _all(F.transform(items, lambda i: _entry(i["title"], i["link"], F.coalesce(mail_date(i["pubDate"]), i["pubDate"]), strip_html(F.coalesce(i["description"], F.lit(""))))))


def atom_entries(xml: Column) -> Column:
    """The same of an Atom feed: the first link's target, the media description as the summary."""
    entries = F.from_xml(xml, _ATOM, {"ignoreNamespace": "true"})["entry"]
    return _all(F.transform(entries, lambda e: _entry(e["title"], F.get(e["link"], F.lit(0))["_href"], e["published"], strip_html(F.coalesce(e["group"]["description"], F.lit(""))))))


def json_entries(raw: Column, mapping: dict[str, str]) -> Column:
    """The same of a JSON array of objects, under the feed's own field names (title, url, date, summary unless mapped)."""
    items = F.from_json(raw, "array<map<string,string>>")
    field = lambda m, name: F.element_at(m, F.lit(mapping.get(name, name)))
    return _all(F.transform(items, lambda m: _entry(field(m, "title"), field(m, "url"), field(m, "date"), field(m, "summary"))))
