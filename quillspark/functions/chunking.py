"""Splitters as folds over arrays: one row in, an array of chunks out, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CHARS, let, strip

#: Fixed value: a last chunk below this share of the limit joins the one before.
TAIL = 0.15


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def pack(parts: Column, limit: int, separator: str) -> Column:
    """Greedy packing of parts into chunks of at most `limit` characters; a longer part is cut up.

    A part counts its length and one separator, except the first of a chunk that follows a full one.
    """
    room = len(separator)
    pieces = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda k: F.substr(p, k * limit + 1, F.lit(limit))))))
    long = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(F.lit(False))).otherwise(F.array_repeat(F.lit(True), F.ceil(F.length(p) / limit).cast("int")))))
    rows = F.arrays_zip(pieces.alias("t"), long.alias("alone"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))
    flush = lambda a: F.when(a["size"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        full = (a["size"] > 0) & (a["size"] + F.length(x["t"]) + room > limit)
        alone = F.struct(F.array_append(flush(a), x["t"]).alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))
        new = F.struct(flush(a).alias("done"), x["t"].alias("now"), F.length(x["t"]).alias("size"))
        more = F.struct(a["done"].alias("done"), F.when(a["size"] > 0, F.concat(a["now"], F.lit(separator), x["t"])).otherwise(x["t"]).alias("now"), (a["size"] + F.length(x["t"]) + room).alias("size"))
        return F.when(x["alone"], alone).when(full, new).otherwise(more)

    return F.aggregate(rows, empty, step, flush)


def merge_tail(chunks: Column, limit: int, separator: str) -> Column:
    n = F.size(chunks)
    last, before = F.element_at(chunks, -1), F.get(chunks, n - 2)
    joined = F.array_append(F.slice(chunks, 1, F.greatest(n - 2, F.lit(0))), F.concat(before, F.lit(separator), last))
    return F.when((n >= 2) & (F.length(last) < limit * TAIL), joined).otherwise(chunks)


def sentence_chunks(c: Column, limit: int) -> Column:
    """Sentences, one a line, in chunks; line ends inside sentences become spaces."""
    flat = F.regexp_replace(F.regexp_replace(c, r"\n(?!\n)", " "), r" {2,}", " ")
    return let(let(_filled(F.split(flat, r"(?<=[.!?…])\s+")), lambda s: pack(s, limit, "\n")), lambda ch: merge_tail(ch, limit, "\n"))


def paragraph_chunks(c: Column, limit: int) -> Column:
    """Paragraphs in chunks; one that is too long gives chunks of its lines."""
    lines = lambda p: let(_filled(F.split(p, "\n")), lambda ls: pack(ls, limit, "\n"))
    paragraphs = F.flatten(F.transform(_filled(F.split(c, r"\n\n")), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(lines(p))))
    return let(let(paragraphs, lambda p: pack(p, limit, "\n\n")), lambda ch: merge_tail(ch, limit, "\n\n"))


def markdown_chunks(c: Column, limit: int) -> Column:
    """Sections, each a heading with what follows, in chunks; a section that is too long is split by paragraphs."""
    sections = _filled(F.split(strip(c), r"(?m)(?=^#{1,6} )"))
    pieces = F.flatten(F.transform(sections, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(paragraph_chunks(s, limit))))
    return let(let(pieces, lambda p: pack(p, limit, "\n\n")), lambda ch: merge_tail(ch, limit, "\n\n"))


def chapters(c: Column) -> Column:
    """Chapters by H1 (two or more, or nothing else) or H2 headings: position, level, title, text; a preamble first."""
    body = F.rtrim(c, F.lit(SPACE_CHARS))
    ones, twos = F.regexp_count(body, F.lit(r"(?m)^# \S")), F.regexp_count(body, F.lit(r"(?m)^## \S"))
    level = F.when((ones >= 2) | ((ones > 0) & (twos == 0)), 1).otherwise(2)
    parts = F.when(level == 1, F.split(body, r"(?m)(?=^# \S)")).otherwise(F.split(body, r"(?m)(?=^## \S)"))
    kept = F.filter(parts, lambda p: strip(p) != "")

    def of(p: Column, i: Column) -> Column:
        heading = F.regexp_extract(p, r"^(?:#{1,2} )([^\n]*)", 1)
        opens = F.when(level == 1, p.rlike(r"^# \S")).otherwise(p.rlike(r"^## \S"))
        title = F.when(opens, F.trim(F.regexp_replace(heading, r"[\s#]+$", ""))).otherwise("(wstęp)")
        return F.struct((i + 1).alias("position"), level.alias("level"), title.alias("title"), F.length(p).alias("length"))

    return F.when(ones + twos == 0, F.filter(F.transform(kept, of), lambda x: F.lit(False))).otherwise(F.transform(kept, of))


def chapter_text(c: Column, position: Column) -> Column:
    """(title, text) of one chapter by its position from 1, trimmed; null where a text has no chapters or none of that number."""
    body = F.rtrim(c, F.lit(SPACE_CHARS))

    def of(found: Column) -> Column:
        before = F.aggregate(F.slice(found, F.lit(1), position.cast("int") - 1), F.lit(0), lambda a, x: a + x["length"])
        here = F.get(found, position.cast("int") - 1)
        # blank parts before the first chapter have no number, but have their length
        skipped = F.length(body) - F.aggregate(found, F.lit(0), lambda a, x: a + x["length"])
        return F.when(here.isNotNull(), F.struct(here["title"].alias("title"), strip(F.substr(body, skipped + before + 1, here["length"])).alias("text")))

    return F.when(position >= 1, let(chapters(c), of))


def windows(c: Column, size: int) -> Column:
    """Consecutive windows of at most `size` characters that end at white space."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\S.{0,%d}(?=\s|$)|\S{1,%d}" % (size - 1, size)), F.lit(0))


def markdown_links(c: Column) -> Column:
    """Text and target of each link that is no image; a target may hold pairs of round brackets."""
    pattern = r"(?<!!)\[([^\]\n]*)\]\(((?:[^()\s]|\([^()\s]*\))*)\)"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("url"))


def plain_markdown(c: Column) -> Column:
    """Without heading marks, emphasis and link targets."""
    out = F.regexp_replace(c, r"(?m)^#{1,6} ", "")
    return F.regexp_replace(F.regexp_replace(out, r"\*\*|__", ""), r"!?\[([^\]]*)\]\([^)]*\)", "$1")


def clock_seconds(c: Column) -> Column:
    """Seconds of [h:]mm:ss."""
    return F.aggregate(F.transform(F.split(c, ":"), lambda x: x.cast("int")), F.lit(0), lambda a, x: a * 60 + x)


def clock(c: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.expr("0") + F.floor(c / 3600).cast("int"), (F.floor(c / 60) % 60).cast("int"), (c % 60).cast("int"))
