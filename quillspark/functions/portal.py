"""Line filters for articles from news portals, and photo credits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CHARS, let, strip, unaccent

#: Headings that open sections to skip, the line that closes them, phrases that stand alone.
SKIP_HEADINGS = ("### Więcej pogłębionych treści", "### Więcej treści premium dla Ciebie", "## Top 5 treści Premium", "## Najlepsze w premium", "## Czytaj także w BUSINESS INSIDER")
SKIP_END = "Więcej w Strefie Premium"
PHRASES = ("Dalszy ciąg materiału pod wideo", "REKLAMAKONIEC REKLAMY", "REKLAMA", "KONIEC REKLAMY", "Lubię to", "[ ]", "Rozwiń", "Zwiń", "Treść zewnętrzna")
AUDIO = "Audio generowane przez AI"
#: What opens a credit, says that a picture only illustrates, names stock houses, agencies, and agencies told by a slash; as plain words, marks apart.
OPENINGS = ("fot .", "foto :", "zdjecie :", "zdj .", "zrodlo zdjecia", "autor zdjecia")
ILLUSTRATIVE = ("zdjecie ilustracyjne", "zdj . ilustracyjne")
STOCK = ("shutterstock", "getty images", "gettyimages", "east news", "adobe stock", "istock", "istockphoto", "depositphotos", "123rf", "unsplash", "pexels")
AGENCIES = ("epa", "afp", "reuters", "bloomberg")
SLASHED = ("pap", "forum")
LONG = 80
CAPTION = 120
AHEAD = 9


def _noise(line: Column) -> Column:
    """Lines that go wherever they stand: reference definitions, lines of marks alone, bare numbers, stock phrases, headings that are links."""
    marks = (line != "") & (F.btrim(line, F.lit("-*_#|" + SPACE_CHARS)) == "")
    number = (line != "") & (F.translate(line, "0123456789", "") == "")
    defines = F.substring_index(line, "[", 1).isin("picture", "link") & F.contains(line, F.lit("]:"))
    linked = F.startswith(line, F.lit("## ")) & line.rlike(r"\[link\d+\]$")
    return marks | number | defines | linked | line.isin(*PHRASES) | F.startswith(line, F.lit(AUDIO))


def _ad_heading(lines: Column, i: Column) -> Column:
    """A second-level heading with a picture or player within the next lines, before other prose."""
    ahead = F.filter(F.slice(lines, i + 2, AHEAD), lambda x: x != "")
    return F.startswith(F.get(lines, i), F.lit("## ")) & F.coalesce(F.get(ahead, F.lit(0)).rlike(r"^!\[|^\[img\d+\]|(?i)^odtwarzacz|^player"), F.lit(False))


def section_marks(kinds: Column) -> Column:
    """For lines by their letters, a "-" for each in a section: from o (opens) on through i (inside) to an e (last); another letter ends it.

    One pass: runs of letters tell the sections. A line goes on right behind one that went (\\G), unless that was the last.
    """
    return F.split(F.regexp_replace(F.array_join(kinds, ""), r"o|\G(?!^)(?<!e)[ie]", "-"), "")


def article_lines(c: Column) -> Column:
    """An article without portal noise and skipped sections.

    Sections run from an opening heading to the next line that closes one. A closing line goes with its section; a bold question
    or a long paragraph closes it too, and stays.
    """

    def kind(lines: Column, t: Column, i: Column) -> Column:
        heading = F.rtrim(F.regexp_replace(t, r"\s*\[link\d+\]", ""))
        question = F.startswith(t, F.lit("**")) & F.substring_index(F.substr(t, F.lit(3)), "**", 1).try_cast("int").isNull()
        prose = (F.length(t) > LONG) & ~F.left(t, F.lit(1)).isin("[", "!")
        return F.when(heading.isin(*SKIP_HEADINGS) | _ad_heading(lines, i), "o").when(F.contains(t, F.lit(SKIP_END)), "e").when(question | prose, "x").otherwise("i")

    def kept(lines: Column) -> Column:
        marks = section_marks(F.transform(lines, lambda t, i: kind(lines, t, i)))
        stays = lambda ms: F.transform(lines, lambda t, i: F.when((F.get(ms, i) != "-") & ~_noise(t), t))
        return F.array_join(F.filter(let(marks, stays), lambda t: t.isNotNull()), "\n")

    return F.regexp_replace(let(F.transform(F.split(c, "\n"), strip), kept), r"\n{3,}", "\n\n")


def spoken(line: Column) -> Column:
    """A line as plain lower-case words, points, colons and slashes, each between spaces; marks of emphasis go."""
    parts = F.regexp_extract_all(F.lower(unaccent(line)), F.lit(r"[\p{L}\p{N}]+|[.:/]"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))


def credit_kind(line: Column) -> Column:
    """What a photo credit of at most CAPTION characters tells of its origin: illustrative, stock, agency, other; null if the line is no credit."""
    said = spoken(line)
    holds = lambda values: F.exists(F.array(*[F.lit(f" {v} ") for v in values]), lambda v: F.contains(said, v))
    opens = F.exists(F.array(*[F.lit(f" {v} ") for v in OPENINGS]), lambda v: F.startswith(said, v))
    agency = holds(AGENCIES) | holds([f"{a} /" for a in SLASHED]) | holds([f"/ {a}" for a in SLASHED])
    kind = F.when(holds(ILLUSTRATIVE), "illustrative").when(holds(STOCK), "stock").when(agency, "agency").when(opens, "other")
    return F.when(F.length(line) <= CAPTION, kind)


def credits(c: Column) -> Column:
    """(line_index, text, category) of the photo credits of a text, in order."""
    rows = F.transform(F.split(c, "\n"), lambda x, i: F.struct(i.alias("line_index"), strip(x).alias("text"), credit_kind(x).alias("category")))
    return F.filter(rows, lambda r: r["category"].isNotNull())


def without_credits(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: credit_kind(x).isNull()), "\n")
