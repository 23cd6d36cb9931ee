"""String operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, title phrases that bait, filler sounds, byline noise.
MARKED = "ąćęłńóśźżäöüßàâçéèêëîïôùûñáíúÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÚĄĆĘŁŃÓŚŹŻ"
PLAIN = "acelnoszzaousaaceeeeiiouunaiuAOUAACEEEEIIOUUNAIUACELNOSZZ"
CLICKBAIT = r"(?iu)(nie uwierzysz|szok(uj[aą]c[a-z]*)?\b|musisz to zobaczy[ćc]|zobacz,? co|a[żz] trudno uwierzy[ćc]|to zmieni (tw[oó]j|wszystko)|jednym trikiem|zdradzi[łl]a? sekret|internauci oszaleli|wszyscy o (tym|niej|nim) m[oó]wi[aą])"
FILLERS = r"(?i)\b(eee+|yyy+|mmm+|hmm+|um+|uh+)\b[,.]?"
BYLINE_NOISE = ("obserwuj", "autor", "autorzy", "autorka", "red.", "redakcja", "opracowanie")


#: ASCII white space, as trim characters.
SPACE_CHARS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body (or a lambda in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unaccent(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def fold(c: Column) -> Column:
    """For comparing names and phrases: lower case, no marks, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(unaccent(c)), r"[^a-z0-9 -]", "")), r"[\s-]+", "-")


def cut_from_last(c: Column, pattern: str) -> Column:
    """Without the last match of the pattern and what follows it."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))
    tail = F.length(last) + F.length(F.try_element_at(F.split(c, pattern), F.lit(-1)))
    return F.when(last.isNotNull(), F.left(c, F.length(c) - tail)).otherwise(c)


def after_first(c: Column, pattern: str) -> Column:
    """What follows the first match, trimmed; all of it where nothing matches."""
    return F.when(c.rlike(f"(?s){pattern}"), strip(F.regexp_replace(c, f"(?s)^.*?(?:{pattern})", ""))).otherwise(c)


def through_first(c: Column, pattern: str) -> Column:
    """Up to and with the first match, trimmed; all of it where nothing matches."""
    found = F.regexp_extract(c, f"(?s)^(.*?(?:{pattern}))", 1)
    return F.when(found != "", strip(found)).otherwise(c)


def without_lines(c: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def head_tail(c: Column, chars: int) -> Column:
    """The first and last characters of a long text; a short one whole."""
    both = F.concat(F.left(c, F.lit(chars)), F.lit("\n...\n"), F.right(c, F.lit(chars)))
    return F.when(F.length(c) <= 2 * chars, c).otherwise(both)


def distinct_by_key(items: Column, key) -> Column:
    """The first of each key, in order."""
    start = F.struct(F.filter(items, lambda x: F.lit(False)).alias("kept"), F.transform(F.filter(items, lambda x: F.lit(False)), key).alias("keys"))
    merged = F.aggregate(
        items,
        start,
        lambda acc, x: F.when(F.array_contains(acc["keys"], key(x)), acc).otherwise(F.struct(F.array_append(acc["kept"], x).alias("kept"), F.array_append(acc["keys"], key(x)).alias("keys"))),
    )
    return merged["kept"]


def author_names(c: Column) -> Column:
    """The names of a byline, without noise words, the first of equals in any case."""
    parts = F.transform(F.split(c, r"(?i)[,;/\n]|(?<!\p{L})(?:i|oraz)(?!\p{L})"), lambda p: strip(p))
    return distinct_by_key(F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*BYLINE_NOISE)), F.lower)


def without_fillers(c: Column) -> Column:
    """Without filler sounds and doubled words, with single spaces."""
    out = F.regexp_replace(F.regexp_replace(c, FILLERS, ""), r"(?i)\b([\p{L}]+)( \1\b)+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([,.!?])", "$1"), r"[ ]{2,}", " "))


def speakers(c: Column, first: str, second: str) -> Column:
    """Turns marked >> given to two speakers alternately; empty parts count as turns but aren't shown."""
    said = F.transform(F.split(c, ">>"), lambda p, i: F.struct(strip(p).alias("t"), F.when(i % 2 == 0, first).otherwise(second).alias("who")))
    return F.array_join(F.transform(F.filter(said, lambda s: s["t"] != ""), lambda s: F.concat(s["who"], F.lit(": "), s["t"])), "\n")


def is_clickbait(title: Column) -> Column:
    return F.coalesce(title.rlike(CLICKBAIT), F.lit(False))


def is_caption(line: Column) -> Column:
    """A photo caption: at most 120 characters with a credit in front or an agency at the end."""
    return (F.length(line) <= 120) & line.rlike(r"(?iu)^\s*(fot\.|foto:|zdj[eę]cie|źródło|photo:|image:|credit:)|(PAP|AFP|Reuters|Getty Images|Shutterstock)\s*$")


def snippets(c: Column, literal: str, around: int) -> Column:
    """The text around each occurrence of a literal."""
    return F.regexp_extract_all(c, F.lit("(?s).{0,%d}\\Q%s\\E.{0,%d}" % (around, literal, around)), F.lit(0))


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text once quotes, dashes and spaces are alike."""
    alike = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), "“”„«»’‘–—", "\"\"\"\"\"''--"), r"\s+", " "))
    return F.contains(alike(text), alike(quote))


def search_terms(c: Column, most: int = 6) -> Column:
    """Terms of a model's list: split, without bullets, up to 80 characters each, the first of equals, at most `most`."""
    parts = F.transform(F.split(c, r"[,;\n]"), lambda p: F.trim(F.regexp_replace(p, r"^\s*([-*•]|\d+[.)])\s*", "")))
    return F.slice(distinct_by_key(F.filter(parts, lambda p: (p != "") & (F.length(p) <= 80)), F.lower), 1, most)


def best_text(markdown: Column, plain: Column) -> Column:
    return F.coalesce(F.nullif(markdown, F.lit("")), plain)
