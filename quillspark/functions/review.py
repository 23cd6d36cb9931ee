"""Excerpts, spans, posts and small normalisations of reviewed texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import year_of
from .text import SPACE_CHARS, let, strip
from .urls import host

#: Platforms by domain, lines that end a post, counted words below a post, marks of a cut text, confidence levels.
PLATFORMS = {"facebook.com": "facebook", "linkedin.com": "linkedin"}
STOP_LINES = (
    "Like", "Comment", "Repost", "Send", "Show more", "See translation", "Translate", "Most relevant", "All comments", "Top comments", "Follow", "Connect",
    "Lubię to!", "Lubię to", "Skomentuj", "Komentarz", "Udostępnij", "Wyślij", "Najtrafniejsze", "Wszystkie komentarze", "Zobacz tłumaczenie", "Przetłumacz", "Obserwuj",
)
COUNTED = ("reaction", "reactions", "comment", "comments", "repost", "reposts", "share", "shares", "reposty", "repostów", "komentarz", "komentarze", "komentarzy", "reakcje", "reakcji", "udostępnie", "udostępnień", "udostępnienia")
SENTENCE_ENDS = (". ", ".\n", "? ", "! ")
CUT_MARK = "\n\n[...tekst przycięty...]"
CONFIDENCE = ("high", "medium", "low")
COMPACT_CHARS, COMPACT_WORDS = 10_000, 1_000


def platform(url: Column) -> Column:
    """The social platform of an address, by its host or a parent of it; null for others."""
    return F.coalesce(*[F.when((host(url) == d) | F.endswith(host(url), F.lit(f".{d}")), F.lit(name)) for d, name in PLATFORMS.items()])


def sentence_tail(c: Column, chars: int) -> Column:
    """The last characters of a long text, from where a sentence begins if one ends in them."""
    seg = F.right(c, F.lit(chars))
    after = [F.when(F.contains(seg, F.lit(end)), F.substr(seg, F.instr(seg, end) + len(end))) for end in SENTENCE_ENDS]
    return F.when(F.length(c) <= chars, c).otherwise(F.coalesce(*after, seg))


def capped(c: Column, chars: int) -> Column:
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.left(c, F.lit(chars)), F.lit(CUT_MARK)))


def post_text(c: Column) -> Column:
    """A post without what stands below it: from the first reaction control, count of reactions, "... more", or two numbers in a row."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), strip(x).alias("t"))), lambda r: r["t"] != "")

    def ends(t: Column) -> Column:
        words = F.split(t, r"\s+")
        counts = (F.size(words) == 2) & (F.translate(F.get(words, F.lit(0)), "0123456789", "") == "") & F.lower(F.get(words, F.lit(1))).isin(*COUNTED)
        return t.isin(*STOP_LINES) | counts | F.regexp_replace(F.lower(t), r"\s+", "").isin("…more", "...more")

    bare = lambda r: F.coalesce((F.length(r["t"]) <= 4) & (F.translate(r["t"], "0123456789", "") == ""), F.lit(False))
    stops = F.filter(F.transform(filled, lambda r, k: F.when(ends(r["t"]) | (bare(r) & bare(F.get(filled, k + 1))), r["i"])), lambda i: i.isNotNull())
    first = F.coalesce(F.array_min(stops), F.size(lines))
    return strip(F.array_join(F.slice(lines, 1, first), "\n"))


def told_date(c: Column, at: Column) -> Column:
    """The day that the first line like "wczoraj, 12:58", "dziś" or "3 godziny temu" means, from when the text was read; null without one."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), strip)
    clock = r"(,? *\d{1,2}:\d{2})?$"

    def day(x: Column) -> Column:
        ago = r"(?iu)^(\d+)\s+(minut|godzin)\p{L}*\s+temu$"
        n, unit = F.regexp_extract(x, ago, 1).try_cast("int"), F.lower(F.regexp_extract(x, ago, 2))
        minutes = n * F.when(unit == "godzin", 60).otherwise(1)
        return F.when(x.rlike(rf"(?iu)^wczoraj{clock}"), F.date_sub(F.to_date(at), 1)).when(x.rlike(rf"(?iu)^(dziś|dzisiaj){clock}"), F.to_date(at)).when(n.isNotNull(), F.to_date(at - F.make_dt_interval(mins=minutes)))

    return F.get(F.filter(F.transform(lines, day), lambda d: d.isNotNull()), F.lit(0))


def ordered(a: Column, b: Column) -> Column:
    """(start, end, swapped) of a range in the right order; open ends stay."""
    turned = F.coalesce(a > b, F.lit(False))
    return F.struct(F.when(turned, b).otherwise(a).alias("start"), F.when(turned, a).otherwise(b).alias("end"), turned.alias("swapped"))


def period(label: Column, start: Column, end: Column, confidence: Column) -> Column:
    """A period that a model named: label of at most 100 characters, whole years in order, a known confidence or low; null without a label."""
    name = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    years = ordered(year_of(start), year_of(end))
    level = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    return F.when(name != "", F.struct(F.left(name, F.lit(100)).alias("label"), years["start"].alias("start"), years["end"].alias("end"), F.when(level.isin(*CONFIDENCE), level).otherwise("low").alias("confidence")))


def fragments(c: Column, limit: int) -> Column:
    """Paragraphs joined up to `limit` characters each; a longer paragraph stands alone, in pieces."""
    paragraphs = F.filter(F.transform(F.split(strip(c), r"\n\s*\n"), strip), lambda p: p != "")
    cuts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda k: F.substr(p, k * limit + 1, F.lit(limit)))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))
    flush = lambda a: F.when(a["now"] != "", F.array_append(a["done"], a["now"])).otherwise(a["done"])

    def step(a: Column, p: Column) -> Column:
        long = F.struct(F.concat(flush(a), cuts(p)).alias("done"), F.lit("").alias("now"))
        full = (a["now"] != "") & (F.length(a["now"]) + 2 + F.length(p) > limit)
        more = F.struct(a["done"].alias("done"), F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit("\n\n"), p)).alias("now"))
        return F.when(F.length(p) > limit, long).when(full, F.struct(flush(a).alias("done"), p.alias("now"))).otherwise(more)

    return F.aggregate(paragraphs, start, step, flush)


def span(original: Column, wanted: Column) -> Column:
    """Where a selected span stands, whatever white space parts its words: (start, end, mid_start, mid_end), start from 0; null if it is empty or nowhere.

    mid_start and mid_end tell whether the span begins or ends inside a word.
    """
    words = F.filter(F.split(F.coalesce(wanted, F.lit("")), r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    at = F.regexp_instr(original, F.array_join(quoted, r"\s+"))
    found = F.regexp_substr(original, F.array_join(quoted, r"\s+"))
    start, end = at - 1, at - 1 + F.length(found)
    word = lambda x: F.coalesce(x.rlike(r"[\p{L}\p{N}_]"), F.lit(False))
    mid_start = (start > 0) & word(F.substr(original, at - 1, F.lit(1))) & word(F.left(found, F.lit(1)))
    mid_end = word(F.substr(original, end + 1, F.lit(1))) & word(F.right(found, F.lit(1)))
    return F.when((F.size(words) > 0) & (at > 0), F.struct(start.alias("start"), end.alias("end"), mid_start.alias("mid_start"), mid_end.alias("mid_end")))


def without_span(original: Column, wanted: Column) -> Column:
    """The text without the first place of the span; as it is where the span is nowhere."""
    s = span(original, wanted)
    return F.when(s.isNull(), original).otherwise(F.concat(F.left(original, s["start"]), F.substr(original, s["end"] + 1)))


def relabelled(query: Column, display: Column) -> Column:
    """A display name whose first part, up to the first comma, is the query instead."""
    rest = F.substr(F.coalesce(display, F.lit("")), F.instr(F.coalesce(display, F.lit("")), ",") + 1)
    return F.when(F.contains(display, F.lit(",")) & (rest != ""), F.concat(query, F.lit(","), rest)).otherwise(query)


def upload_name(key: Column) -> Column:
    """The name of an uploaded file from its key: the last part of the path, behind its first dash."""
    name = F.element_at(F.split(key, "/"), -1)
    return F.when(F.contains(name, F.lit("-")), F.substr(name, F.instr(name, "-") + 1)).otherwise(name)


def audio_price(seconds: Column, per_minute: float) -> Column:
    """The price of whole minutes begun, to two places."""
    return F.round(F.ceil(seconds / 60) * F.lit(per_minute), 2)


def is_compact(c: Column, chapters: Column) -> Column:
    """Whether a short text of several chapters is read as one."""
    return (chapters > 1) & (F.length(c) <= COMPACT_CHARS) & (F.regexp_count(c, F.lit(r"\S+")) <= COMPACT_WORDS)


#: Beginnings of words that tell of a person's life, and whole words that do.
LIFE_STEMS, LIFE_WORDS = ("by", "prac", "zacz", "zajm", "specjaliz", "dziennikar", "autor", "uko", "redakcj"), ("jest", "studiach")
LATE, NEAR, COMPACT, WITHIN = 0.65, 80, 80, 5


def author_biography(text: Column, author: Column) -> Column:
    """(body, biography) of a text that ends with a block on its author: the last paragraph in the final 35 % that names the author of two names or more near its beginning.

    A paragraph of over 80 characters that tells of a life is the biography by itself; else it is all from that paragraph, if it or one of
    the next four does. Biography is null where there is none, and then the body is the text.
    """
    life = r"(?iU)\b(?:(?:" + "|".join(LIFE_STEMS) + r")\w*|" + "|".join(LIFE_WORDS) + r")\b"
    name = strip(F.coalesce(author, F.lit("")))
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s).*?(?:\n\s*\n|\z)"), F.lit(0)), lambda b: b != "")

    def of(bs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("all"))
        lead = lambda b: F.length(b) - F.length(F.ltrim(b, F.lit(SPACE_CHARS)))
        grow = lambda s, b: F.struct((s["at"] + F.length(b)).alias("at"), F.array_append(s["all"], F.struct((s["at"] + lead(b)).alias("start"), strip(b).alias("value"))).alias("all"))
        return let(F.aggregate(bs, start, grow)["all"], chosen)

    def chosen(ps: Column) -> Column:
        told = F.transform(ps, lambda p, i: F.struct(p["start"].alias("start"), p["value"].alias("value"), F.array_join(F.transform(F.slice(ps, i + 1, F.lit(WITHIN)), lambda x: x["value"]), "\n\n").alias("next")))
        own = lambda p: (F.length(p["value"]) > COMPACT) & p["value"].rlike(life)
        by_author = lambda p: F.instr(F.lower(p["value"]), F.lower(name)).between(1, NEAR + 1)
        fits = lambda p: (p["start"] >= F.floor(F.length(text) * LATE)) & by_author(p) & (own(p) | p["next"].rlike(life))
        last = F.try_element_at(F.filter(told, fits), F.lit(-1))
        body = lambda p: F.rtrim(F.left(text, p["start"]), F.lit(SPACE_CHARS))
        split = lambda p: F.struct(body(p).alias("body"), F.when(own(p), p["value"]).otherwise(strip(F.substr(text, p["start"] + 1))).alias("biography"))
        return F.when(last.isNotNull(), let(last, split))

    none = F.struct(text.alias("body"), F.lit(None).cast("string").alias("biography"))
    return F.when(F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) >= 2, F.coalesce(let(blocks, of), none)).otherwise(none)
