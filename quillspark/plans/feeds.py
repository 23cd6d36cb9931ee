"""Feeds: entries built from the pages, and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import feeds as P
from .registry import query, shaped, shaped_sql

_ENTRIES = "SELECT page_id % 10 AS feed, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1 AS position, 'Title ' || page_id AS title, url, {published} AS published, {summary} AS summary FROM pages"


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _feeds(t, item, head: str, tail: str):
    rows = t("pages").withColumn("position", F.row_number().over(Window.partitionBy(F.col("page_id") % 10).orderBy("page_id")))
    items = rows.groupBy((F.col("page_id") % 10).alias("feed")).agg(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))).alias("xs"))
    return items.select("feed", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda s: s["x"]), ""), F.lit(tail)).alias("raw"))


def _rows(feeds, entries):
    return feeds.select("feed", F.posexplode(entries).alias("position", "e")).select("feed", F.col("position").cast("long").alias("position"), "e.*")


@query(_ENTRIES.format(published="CASE WHEN page_id % 3 = 0 THEN '2024-03-0' || (page_id % 9 + 1) || 'T10:00:00+01:00' WHEN page_id % 3 = 1 THEN 'soon' ELSE '' END", summary="CASE WHEN page_id % 2 = 0 THEN 'Bold ' || page_id ELSE '' END"))
def feed_rss(t):
    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<pubDate>Fri, 0"), F.col("page_id") % 9 + 1, F.lit(" Mar 2024 10:00:00 +0100</pubDate>"))).when(F.col("page_id") % 3 == 1, "<pubDate>soon</pubDate>").otherwise("")
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<description><![CDATA[<b>Bold</b> "), F.col("page_id"), F.lit("]]></description>"))).otherwise("")
    item = F.concat(F.lit("<item><title> Title "), F.col("page_id"), F.lit(" </title><link>"), _escaped(F.col("url")), F.lit("</link>"), date, text, F.lit("</item>"))
    return _rows(_feeds(t, item, '<rss version="2.0"><channel><title>Feed</title>', "</channel></rss>"), P.rss_entries(F.col("raw")))


@query(_ENTRIES.format(published="'2024-03-01T00:00:00+00:00'", summary="CASE WHEN page_id % 2 = 0 THEN 'About ' || page_id ELSE '' END"))
def feed_atom(t):
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<media:group><media:description>About "), F.col("page_id"), F.lit("</media:description></media:group>"))).otherwise("")
    item = F.concat(F.lit("<entry><title>Title "), F.col("page_id"), F.lit('</title><link rel="alternate" href="'), _escaped(F.col("url")), F.lit('"/><published>2024-03-01T00:00:00+00:00</published>'), text, F.lit("</entry>"))
    return _rows(_feeds(t, item, '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>Feed</title>', "</feed>"), P.atom_entries(F.col("raw")))


@query(_ENTRIES.format(published="CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '' END", summary="page_id::VARCHAR"))
def feed_json(t):
    """Objects whose fields have other names; a missing field is empty, a number is text."""
    fields = F.struct(F.concat(F.lit(" Title "), F.col("page_id")).alias("name"), F.col("url").alias("link"), F.when(F.col("page_id") % 2 == 0, "2024-01-01").alias("date"), F.col("page_id").alias("summary"))
    rows = t("pages").groupBy((F.col("page_id") % 10).alias("feed")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_id", fields.alias("o")))), lambda s: s["o"])).alias("raw"))
    return _rows(rows, P.json_entries(F.col("raw"), {"title": "name", "url": "link"}))


_KINDS = [("rss", "https://a.example/{}", None, "https://a.example/{}"), ("wordpress", "https://b.example/w", None, "https://b.example/w"), ("youtube_channel", None, "UC{}", P.CHANNEL_FEED + "UC{}"), ("json_api", "https://c.example/j", "x", "https://c.example/j"), ("gopher", "gopher://d", None, None)]


@query(shaped_sql(_KINDS, "kind, url, channel, address"))
def feed_urls(t):
    return shaped(t, [r[:3] for r in _KINDS], "kind string, url string, channel string").withColumn("address", P.feed_url(F.col("kind"), F.col("url"), F.col("channel"))).drop("shape")


_DATES = [
    ("Fri, 01 Mar 2024 10:00:00 +0100", 1709283600),
    ("1 Mar 2024 09:00 GMT", 1709283600),
    ("2024-03-01T10:00:00+01:00", 1709283600),
    ("2024-03-01T09:00:00Z", 1709283600),
    ("Thu, 29 Feb 2024 23:30:15 -0230", 1709258415),
    ("30 Feb 2024 10:00:00 +0000", None),
    ("yesterday {}", None),
    ("", None),
    (None, None),
]


@query(shaped_sql(_DATES, "raw, seconds"))
def feed_dates(t):
    return shaped(t, [r[:1] for r in _DATES], "raw string").withColumn("seconds", F.unix_timestamp(P.published_at(F.col("raw")))).drop("shape")
