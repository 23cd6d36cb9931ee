"""Splitters by words, repair of broken links, numbered pictures, mail to text, and dates with their places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import let
from .text import strip
from .urls import unescape

#: What begins a part, from the widest to the narrowest, and the name of a picture without one.
HEADS = (r"\n# ", r"\n## ", r"\n### ", r"\n\*\*", r"\n— \*\*")
UNNAMED = "Brak opisu"
NUMBERS = r"\d+(?:[./-]\d+)+"
AROUND = 220


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def by_sentences(c: Column, most: int) -> Column:
    """Sentences, without the marks that end them, cut every `most` words."""
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    cuts = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / most).cast("int")), lambda k: F.array_join(F.slice(ws, k * most + 1, F.lit(most)), " "))
    return F.flatten(F.transform(F.filter(F.split(c, r"[.!?] "), lambda s: strip(s) != ""), lambda s: let(words(s), cuts)))


def by_paragraphs(c: Column, most: int) -> Column:
    """A short text whole; else paragraphs, a line end between them, up to `most` words a part; a longer paragraph gives parts of its sentences, in their place."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    flush = lambda a: F.when(a["now"] != "", F.array_append(a["done"], a["now"])).otherwise(a["done"])

    def step(a: Column, p: Column) -> Column:
        long = F.struct(F.concat(flush(a), by_sentences(p, most)).alias("done"), F.lit("").alias("now"))
        full = F.struct(flush(a).alias("done"), p.alias("now"))
        more = F.struct(a["done"].alias("done"), F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit("\n"), p)).alias("now"))
        return F.when(n_words(p) > most, long).when(n_words(a["now"]) + n_words(p) > most, full).otherwise(more)

    paragraphs = F.filter(F.split(c, "\n\n"), lambda p: strip(p) != "")
    return F.when(n_words(c) <= most, F.array(c)).otherwise(F.aggregate(paragraphs, start, step, flush))


def by_headings(c: Column, limit: int) -> Column:
    """Parts of fewer than `limit` words: cut at first-level headings, those too long at the next level, at bold openings, at last by paragraphs."""

    def at(level: int, part: Column) -> Column:
        if level == len(HEADS):
            return by_paragraphs(part, limit)
        cut = F.filter(F.split(part, f"(?={HEADS[level]})"), lambda p: strip(p) != "")
        return F.when(n_words(part) < limit, F.array(part)).otherwise(F.flatten(F.transform(cut, lambda p: at(level + 1, p))))

    return at(0, c)


def whole_links(c: Column) -> Column:
    """Links that a line end breaks, joined again; a line end before another link or a capital letter stays."""
    return F.regexp_replace(c, r"(https://|\G(?!\A))([^ )\]\r\n]*)[\r\n](?![\r\n ]*(?:https?://|\p{Lu}))", "$1$2")


def numbered_images(c: Column, ignored: tuple[str, ...] = ()) -> Column:
    """(text, images): pictures of markdown as [1], [2], ... and their (number, alt, url); ignored addresses go without a number."""
    pattern = r"!\[([^\]\n]*)\]\(([^)\n]*)\)"
    all_of = lambda g: F.regexp_extract_all(c, F.lit(pattern), F.lit(g))
    rows = F.transform(F.arrays_zip(all_of(1).alias("alt"), all_of(2).alias("url")), lambda x: F.struct(F.when(x["alt"] == "", UNNAMED).otherwise(x["alt"]).alias("alt"), x["url"].alias("url"), (~x["url"].isin(*ignored)).alias("kept") if ignored else F.lit(True).alias("kept")))

    def of(images: Column) -> Column:
        number = lambda k: F.size(F.filter(F.slice(images, F.lit(1), k), lambda x: x["kept"]))
        mark = lambda k: F.when(F.get(images, k - 1)["kept"], F.concat(F.lit("["), number(k), F.lit("]"))).otherwise("")
        text = F.array_join(F.transform(F.split(c, pattern), lambda p, k: F.when(k == 0, p).otherwise(F.concat(mark(k), p))), "")
        kept = F.filter(images, lambda x: x["kept"])
        return F.struct(text.alias("text"), F.transform(kept, lambda x, k: F.struct((k + 1).alias("number"), x["alt"].alias("alt"), x["url"].alias("url"))).alias("images"))

    return let(rows, of)


#: What each tag of a mail yields; all others yield nothing. Bold and italics are told apart from these, as they come in pairs.
_LINE_ENDS = ("br", "p", "div", "tr", "table", "section", "article", "header", "footer", "ul", "ol")
TAGS = {mark + name: "\n" for name in _LINE_ENDS for mark in ("", "/")} | {f"h{k}": "\n" + "#" * k + " " for k in range(1, 7)} | {f"/h{k}": "\n" for k in range(1, 7)} | {"li": "\n- "}
STARS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
UNSEEN = r"(?is)<(head|style|script)\b[^>]*>.*?</\1\b[^>]*>|<!--.*?-->"


def mail_text(c: Column) -> Column:
    """The text of a mail in HTML: blocks and breaks end lines, headings get #, items a dash, links their address, bold and italics stars.

    The mail is cut into tags and texts; a fold over them knows the open link and the open stars. A closing tag without its opening one yields nothing.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(c, UNSEEN, ""), F.lit(r"<[^<>]+>|[^<]+|<"), F.lit(0))
    look = lambda name, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)
    without = lambda xs, k: F.concat(F.slice(xs, F.lit(1), k - 1), F.slice(xs, k + 1, F.size(xs)))
    start = F.struct(F.lit(None).cast("string").alias("link"), F.array().cast("array<string>").alias("stars"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^<\s*(/?[A-Za-z][A-Za-z0-9]*)[\s/>]", 1))
        plain, bare = ~token.rlike("(?s)^<.+>$"), token.rlike(r"(?i)^<[a-z]+\s*>$")
        href = F.nullif(F.regexp_extract(token, r'(?is)\shref="([^"]*)"', 1), F.lit(""))
        opens, closes = look(name, STARS), look(F.regexp_extract(name, "^/(.+)$", 1), STARS)
        opened, closed = bare & opens.isNotNull(), closes.isNotNull() & F.array_contains(s["stars"], closes)
        told = (
            F.when(plain, token)
            .when(opened, opens)
            .when(closed, closes)
            .when((name == "/a") & s["link"].isNotNull(), F.concat(F.lit(" ("), s["link"], F.lit(")")))
            .otherwise(F.coalesce(look(name, TAGS), F.lit("")))
        )
        stars = F.when(opened, F.array_append(s["stars"], opens)).when(closed, without(s["stars"], F.array_position(s["stars"], closes).cast("int"))).otherwise(s["stars"])
        link = F.when(name == "a", href).when(name == "/a", F.lit(None)).otherwise(s["link"])
        return F.struct(link.alias("link"), stars.alias("stars"), F.array_append(s["out"], told).alias("out"))

    text = unescape(F.array_join(F.aggregate(tokens, start, step)["out"], ""))
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def _dates_of(run: Column) -> Column:
    """(from, numbers) of the dates in a run of numbers parted by marks: a day, a month and perhaps a year of two or four digits, from the left."""
    numbers = F.split(run, r"[./-]")
    within = lambda k, low, high: F.length(F.get(numbers, k)).between(1, 2) & F.get(numbers, k).try_cast("int").between(low, high)

    def step(s: Column, k: Column) -> Column:
        is_date = (k >= s["free"]) & F.coalesce(within(k, 1, 31) & within(k + 1, 1, 12), F.lit(False))
        n = F.when(F.length(F.get(numbers, k + 2)).isin(2, 4), 3).otherwise(2)
        return F.when(is_date, F.struct((k + n).alias("free"), F.array_append(s["found"], F.struct(k.alias("at"), n.alias("n"))).alias("found"))).otherwise(s)

    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(numbers) - 1), start, step)["found"]
    reach = lambda k: F.length(F.array_join(F.slice(numbers, 1, k), "."))
    begin = lambda d: F.when(d["at"] == 0, 0).otherwise(reach(d["at"]) + 1)
    return F.transform(found, lambda d: F.struct(begin(d).alias("from"), F.substr(run, begin(d) + 1, reach(d["at"] + d["n"]) - begin(d)).alias("date")))


def dated_places(c: Column) -> Column:
    """(start, date, around) of each date in figures such as 5.04 or 12/11/2023, with the text up to 220 characters around it; start counts from 0."""
    lengths = lambda xs, n: F.aggregate(F.transform(F.slice(xs, F.lit(1), n), F.length), F.lit(0), lambda a, x: a + x)

    def of(z: Column) -> Column:
        before = lambda k: lengths(z["between"], k + 1) + lengths(z["runs"], k)
        dates = F.flatten(F.transform(z["runs"], lambda run, k: F.transform(_dates_of(run), lambda d: F.struct((before(k) + d["from"]).alias("start"), d["date"].alias("date")))))
        left = lambda p: F.greatest(p["start"] - AROUND, F.lit(0))
        return F.transform(dates, lambda p: F.struct(p["start"].alias("start"), p["date"].alias("date"), strip(F.substr(c, left(p) + 1, p["start"] + F.length(p["date"]) + AROUND - left(p))).alias("around")))

    return let(F.struct(F.regexp_extract_all(c, F.lit(NUMBERS), F.lit(0)).alias("runs"), F.split(c, NUMBERS).alias("between")), of)
