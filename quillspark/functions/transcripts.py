"""Timed transcripts and their chapters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import clock_seconds
from .text import strip

#: The end of a last chapter, in seconds; the schema of a raw transcript.
OPEN_END = 99_999 * 60
RAW = "array<struct<text:string,start:double>>"
_TIME = r"(\d{1,2}:\d{2}(?::\d{2})?)"


def chapter_list(c: Column) -> Column:
    """Lines of `title mm:ss` or `mm:ss - title` as (start, end, title); a chapter ends where the next begins. Lines without a time are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x.rlike(f"^{_TIME}|{_TIME}$"))
    time = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, f"^{_TIME}", 1), F.lit("")), F.regexp_extract(x, f"{_TIME}$", 1))
    title = lambda x: F.btrim(F.when(x.rlike(f"^{_TIME}"), F.regexp_replace(x, f"^{_TIME}", "")).otherwise(F.regexp_replace(x, f"{_TIME}$", "")), F.lit(" -–—:|\t"))
    rows = F.transform(lines, lambda x: F.struct(clock_seconds(time(x)).alias("start"), title(x).alias("title")))
    return F.transform(rows, lambda r, i: F.struct(r["start"].alias("start"), F.coalesce(F.get(rows, i + 1)["start"], F.lit(OPEN_END)).alias("end"), r["title"].alias("title")))


def with_chapters(raw: Column, chapters: Column) -> Column:
    """The text of a raw transcript with a heading where a chapter begins. A time out of order doesn't reopen an earlier chapter."""
    at = lambda s: F.size(F.filter(chapters, lambda c: c["start"] <= s)) - 1
    start = F.struct(F.lit(-1).alias("now"), F.array().cast("array<string>").alias("lines"))

    def step(a: Column, e: Column) -> Column:
        here = F.greatest(at(e["start"]), a["now"])
        heading = F.when(here > a["now"], F.array(F.concat(F.lit("## "), F.get(chapters, here)["title"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(here.alias("now"), F.concat(a["lines"], heading, F.array(strip(e["text"]))).alias("lines"))

    return F.aggregate(F.from_json(raw, RAW), start, step, lambda a: F.array_join(a["lines"], "\n"))


def chapters_within(start: Column, end: Column, chapters: Column) -> Column:
    """Titles of the chapter that is on at a chunk's start and of those that begin inside it."""
    return F.transform(F.filter(chapters, lambda c: (c["start"] < end) & (c["end"] > start)), lambda c: c["title"])


def topics(text: Column) -> Column:
    """Labelled model output (`TYPE: ... TOPIC: ... TEXT: ...`) as (type, topic, text)."""
    part = lambda name: strip(F.regexp_extract(text, rf"(?s)(?:^|\n){name}:[ ]*(.*?)(?=\n(?:TYPE|TOPIC|TEXT):|\z)", 1))
    return F.struct(F.upper(part("TYPE")).alias("type"), part("TOPIC").alias("topic"), part("TEXT").alias("text"))


#: Fixed value: a chunk whose rewrite is shorter than this percentage of it counts as shortened.
SHORTENED = 80


def run_json(doc_id: Column, title: Column, chunks: Column) -> Column:
    """An analysis run as one JSON document. chunks: array of (index, type, topic, original, corrected, summary), in order."""
    ratio = lambda x: F.when(F.length(x["original"]) > 0, F.round(100 * F.length(x["corrected"]) / F.length(x["original"]), 1)).otherwise(0.0)
    of_kind = lambda kind: F.size(F.filter(chunks, lambda x: x["type"] == kind))
    meta = F.struct(doc_id.alias("doc_id"), title.alias("title"), F.size(chunks).alias("chunk_count"), of_kind("TEMAT").alias("content_chunks"), of_kind("REKLAMA").alias("ad_chunks"), F.size(F.filter(chunks, lambda x: ratio(x) < SHORTENED)).alias("short_chunks"))
    told = F.transform(chunks, lambda x: F.struct(x["index"].alias("index"), x["type"].alias("type"), x["topic"].alias("topic"), ratio(x).alias("ratio"), x["original"].alias("original"), x["corrected"].alias("corrected"), x["summary"].alias("summary")))
    return F.to_json(F.struct(meta.alias("meta"), told.alias("chunks")))


def run_markdown(title: Column, chunks: Column) -> Column:
    """An analysis run as a note: its title, then each chunk with its number, topic, summary of content, and text."""
    block = lambda x: F.concat(F.lit("### "), x["index"], F.lit(". "), x["topic"], F.lit("\n\n"), F.when((x["type"] == "TEMAT") & (F.coalesce(x["summary"], F.lit("")) != ""), F.concat(F.lit("**"), x["summary"], F.lit("**\n\n"))).otherwise(F.lit("")), x["corrected"])
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(chunks, block), "\n\n"))


def run_html(title: Column, chunks: Column) -> Column:
    """An analysis run as a page; what a text holds of markup is shown, not obeyed."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = lambda x: F.concat(F.lit("<h3>"), x["index"], F.lit(". "), safe(x["topic"]), F.lit("</h3><p>"), safe(x["corrected"]), F.lit("</p>"))
    return F.concat(F.lit("<html><body><h1>"), safe(title), F.lit("</h1>"), F.array_join(F.transform(chunks, block), ""), F.lit("</body></html>"))
