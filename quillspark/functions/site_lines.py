"""Line rules of single portals, pictures and links as numbered markers with captions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extraction
from .portal import section_marks
from .text import SPACE_CHARS, let, strip
from .urls import host

Test = Callable[[Column], Column]

#: URLs of a portal's own tags, sections and authors; pictures that are icons; endings of picture files.
INTERNAL = (r"/wiadomosci/[\w-]+\.html$", "/tag/", r"0%2C128956\.html\?tag=", r"wiadomosci\.onet\.pl/[\w-]+$", r"onet\.pl/premium$", r"onet\.pl/autorzy/", "/archiwum/autor/", "/autor/", "(%2C|,)temat(%2C|,)")
ICONS = ("onetmobilemainpage/emotion/", "onetmobilemainpage/onet30/subServiceLogos/")
PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp")
#: The menu and the bar of reactions of one portal, a line each; what introduces and names the source of a reprint.
MENU = ("Polska", "Świat", "Wydarzenia lokalne", "Okiem Interii", "Wojna w Ukrainie", "Pogoda", "Redakcja", "Religia", "Felietoniści", "Raporty", "Baza wiedzy", "Zielona Interia")
REACTIONS = ("Super", "Hahaha", "Szok", "Smutny", "Zły")
REPRINT, REPRINT_OF = "interia współpracuje z czołowymi redakcjami na świecie.", r'(?i)["„]\s*([^"„”\n]{2,80}?)\s*["”],\s*z którego pochodzi (?:poniższy|powyższy|niniejszy)\s+artykuł'
#: Categories of captions that tell where a picture comes from, whatever stands around them.
ORIGINS = ("public_domain", "creative_commons", "own_or_private_archive", "illustrative", "stock", "agency")
SUMMARY = 5
LONG_URL = 200
PICTURE = r"!\[([^\]]*)\]\(([^)]*)\)"
LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def figures(line: Column) -> Column:
    """The line with each number as 0, so that one value stands for all of its kind."""
    return F.regexp_replace(line, r"\d+", "0")


def unlinked(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"\s*\[link\d+\]", ""))


@dataclass(frozen=True)
class Section:
    """Lines from one that opens, on through lines inside, to one that is last; a line of no kind ends it and stays.

    Backward sections run up from the line that opens them, and leave empty lines where they are.
    """

    opens: Test
    inside: Test
    last: Test = lambda x: F.lit(False)
    backward: bool = False


@dataclass(frozen=True)
class Site:
    """What goes from a portal's articles: sections first, then lines told by their words with numbers as 0."""

    whole: tuple[str, ...] = ()
    begins: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    tests: tuple[Test, ...] = ()
    sections: tuple[Section, ...] = ()


def _is(*values: str) -> Test:
    return lambda x: x.isin(*values)


def _empty(x: Column) -> Column:
    return x == ""


def _moment(x: Column) -> Column:
    """A date and a time: day, month in letters, year."""
    return F.regexp_replace(F.regexp_replace(figures(x), r"\p{L}+", "a"), r"\s+", " ").isin("0 a 0, 0:0", "0 a 0 0:0")


def _counted_tags(x: Column) -> Column:
    """Words and, last, how many more there are: economy power +3."""
    t = unlinked(x)
    words = F.substring_index(t, "+", 1)
    return F.endswith(figures(t), F.lit("+0")) & (F.length(t) - F.length(F.replace(t, F.lit("+"), F.lit(""))) == 1) & (words != "") & (F.regexp_replace(words, r"[\p{L}\p{N}_\s]", "") == "")


def _author_mail(x: Column) -> Column:
    return F.lower(x).rlike(r"^[\w.+-]+@grupawp\.pl\s*o autorze$")


def _comments(x: Column) -> Column:
    return F.regexp_replace(figures(x), r"\s+", " ").startswith("0 komentarz")


def _ago(x: Column) -> Column:
    t = F.regexp_replace(F.lower(figures(x)), r"\s+", " ")
    return t.rlike(r"^0 (minut|godzin)\w* temu$") | F.replace(t, F.lit(" "), F.lit("")).isin("wczoraj,0:0", "dzis,0:0", "dziś,0:0", "dzisiaj,0:0", "dziśiaj,0:0")


def _reactions(x: Column) -> Column:
    t = figures(x)
    return F.startswith(t, F.lit("[img0]")) & F.regexp_replace(F.replace(t, F.lit("[img0]"), F.lit("")), r"\s*tys\.$", "").isin("0", "0,0")


def _native_ad(x: Column) -> Column:
    return F.startswith(x, F.lit("[")) & F.endswith(x, F.lit(")")) & (F.length(x) > 300)


def _see_also(x: Column) -> Column:
    """A picture with words and, behind it, a link into the same portal."""
    t = figures(x)
    return (F.startswith(t, F.lit("[img0:")) | F.startswith(t, F.lit("[[img0:"))) & F.contains(F.regexp_replace(x, r"^[^\]]*\]", ""), F.lit("money.pl/"))


def _filled(x: Column) -> Column:
    return x != ""


_BIOGRAPHY = Section(_author_mail, _empty, _filled, backward=True)
_SHARED = ("Skomentuj", "Udostępnij", "Słuchaj", "Kopiuj link")
_SHARED_BEGINS = ("Udostępnij na ", "Źródło zdjęć:", "Źródło artykułu:", "oprac.", "Dźwięk został wygenerowany")
_SUBMENU = ("Notowania", "Kalendarium", "Dywidendy", "Narzędzia", "Portfel", "Forum")

#: Fixed values, but for the tests: the lines of each portal that are no part of an article, with numbers as 0.
SITES = {
    "onet": Site(
        whole=("Posłuchaj artykułu", "Skróć artykuł", "- x0 +", "x0", "x0.0", "Obserwuj", "Więcej pogłębionych treści", "Więcej treści premium dla Ciebie", "Więcej takich artykułów znajdziesz na stronie głównej Onetu", "Top 0 treści Premium", "CZYTAJ TAKŻE", "ZOBACZ RÓWNIEŻ", "Dodaj w Google", "Wróć na", "Jesteś w strefie", "0 min czytania"),
        begins=("Zapytaj o więcej Onet Czat z AI", "**0** ### ", "Powiązane tematy:", "Opracowanie: "),
        holds=("Więcej w Strefie Premium",),
        tests=(_moment, _reactions, lambda x: F.startswith(x, F.lit("**PRZECZYTAJ CAŁY ")) & F.endswith(unlinked(x), F.lit("**")) & (F.regexp_count(x, F.lit(r"\*")) == 4)),
        sections=(Section(_is("Top treści w Premium"), lambda x: _empty(x) | (F.startswith(figures(x), F.lit("0 ")) & F.endswith(figures(x), F.lit("[link0]")))),),
    ),
    "money": Site(
        whole=(*_SHARED, "Notowania"),
        begins=_SHARED_BEGINS,
        tests=(_author_mail, _moment, _comments, _counted_tags, _see_also),
        sections=(_BIOGRAPHY, Section(lambda x: F.startswith(x, F.lit("Źródło artykułu:")), _empty, lambda x: x.rlike("^[A-Z]$"))),
    ),
    "wp": Site(
        whole=(*_SHARED, "Zaloguj", "Obserwuj nas na:", "Wyłączono komentarze"),
        begins=(*_SHARED_BEGINS, "Jako redakcja Wirtualnej Polski", "Redakcja serwisu o0", "Misja AI"),
        tests=(_author_mail, _moment, _comments, _counted_tags, _native_ad, lambda x: F.contains(F.lower(x), F.lit("dziennikarz")) & F.contains(F.lower(x), F.lit("wirtualnej polski"))),
        sections=(
            _BIOGRAPHY,
            Section(lambda x: figures(x) == "+0", lambda x: _empty(x) | x.rlike("^[a-ząćęłńóśźż][a-ząćęłńóśźż ]{0,40}$"), backward=True),
            Section(_is("PREMIUM Zapisz się na newsletter!"), _is("Newsy, wywiady, śledztwa i reportaże w Twojej skrzynce co tydzień - zawsze za darmo."), _is("Zapisz mnie")),
        ),
    ),
    "interia": Site(whole=("Udostępnij", "Odsłuchaj artykuł", "W skrócie", "Zobacz również:"), tests=(_ago,)),
    "bankier": Site(
        whole=("publikacja", "ad", "0-0-0 0:0"),
        tests=(lambda x: F.startswith(x, F.lit("Bankier.pl")) & (F.length(x) < 80), lambda x: F.size(F.filter(F.array(*map(F.lit, _SUBMENU)), lambda w: F.contains(x, w))) >= 3),
        sections=(Section(_is("Źródło:"), _empty, _filled), Section(_is("tematy"), lambda x: _filled(x) & (F.length(x) < 60), _empty)),
    ),
    "gazeta": Site(
        tests=(lambda x: F.lower(figures(x)) == "otwórz galerię (0)", lambda x: F.lower(figures(x)).isin("przejdź na", "przejdź na [link0]")),
        sections=(Section(lambda x: unlinked(x).isin("Czytaj także:", "Czytaj również:"), lambda x: (F.length(unlinked(x)) < 100) | F.left(x, F.lit(1)).isin("[", "!")),),
    ),
    "ithardware": Site(whole=("Play", "ad")),
}


def _without_section(lines: Column, s: Section) -> Column:
    def kept(rows: Column) -> Column:
        marks = section_marks(F.transform(rows, lambda x: F.when(s.opens(x), "o").when(s.last(x), "e").when(s.inside(x), "i").otherwise("x")))
        gone = lambda x, m: (m == "-") & (F.lit(not s.backward) | (x != ""))
        return let(marks, lambda ms: F.filter(F.transform(rows, lambda x, i: F.when(~gone(x, F.get(ms, i)), x)), lambda x: x.isNotNull()))

    return F.reverse(let(F.reverse(lines), kept)) if s.backward else let(lines, kept)


def _noise(line: Column, site: Site) -> Column:
    bare = figures(F.regexp_replace(line, r"^#{1,6}\s+", ""))
    found = [bare.isin(*site.whole)] if site.whole else []
    found += [F.startswith(figures(line), F.lit(b)) for b in site.begins] + [F.contains(line, F.lit(h)) for h in site.holds] + [t(line) for t in site.tests]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def _without_noise(lines: Column, site: Site) -> Column:
    return F.filter(lines, lambda x: ~_noise(x, site))


def portal_lines(c: Column, url: Column) -> Column:
    """A text without the lines that its portal puts into every article. Lines are stripped; texts of other sites stay."""
    name = site_name(url)
    lines = F.transform(F.split(c, r"\r?\n"), strip)
    out = None
    for portal, site in SITES.items():
        rest = lines
        for s in site.sections:
            rest = _without_section(rest, s)
        rest = F.array_join(_without_noise(rest, site), "\n")
        out = F.when(name == portal, rest) if out is None else out.when(name == portal, rest)
    return out.otherwise(c)


def site_name(url: Column) -> Column:
    return F.coalesce(extraction.portal(url), F.when(host(url).rlike(r"(^|\.)ithardware\.pl$"), "ithardware"))


def without_summary(c: Column) -> Column:
    """Without a list of exactly SUMMARY points before anything else."""
    return F.regexp_replace(c, rf"^((?:\s*\n)?)(?:[ \t]*[*-][ \t]+\S[^\n]*(?:\n|$)){{{SUMMARY}}}(?![ \t]*[*-][ \t]+\S)", "$1")


def without_rows(c: Column, values: tuple[str, ...]) -> Column:
    """Without whole runs of these lines in their order, empty lines between them or not."""
    return F.regexp_replace(c, r"(?m)^[ \t]*" + r"[ \t]*\n\s*".join(values) + r"[ \t]*$", "")


def reprint(c: Column) -> Column:
    """(text, source): without the paragraph that announces a reprint, and the paper that it names; the text as it is if none."""
    at = F.instr(F.lower(c), F.lit(REPRINT))
    before, rest = F.substr(c, F.lit(1), at - 1), F.substr(c, at)
    paragraph = F.regexp_extract(rest, r"(?s)^.*?(?=\n\s*\n|\z)", 0)
    name = F.nullif(F.regexp_extract(paragraph, REPRINT_OF, 1), F.lit(""))
    found = (at > 0) & name.isNotNull()
    text = F.when(found, F.concat(F.regexp_replace(before, r"\*$", ""), F.substr(rest, F.length(paragraph) + 1))).otherwise(c)
    return F.struct(text.alias("text"), F.when(found, strip(name)).alias("source"))


def _replaced(c: Column, pattern: str, told, marked) -> Column:
    """(text, found): matches of a pattern as told(match) tells them, each put back as marked(row, number) says, numbered where row.counts."""

    def numbered(rows: Column) -> Column:
        counts = F.filter(F.transform(rows, lambda r, i: F.when(r["counts"], i)), lambda i: i.isNotNull())

        def put(ns: Column) -> Column:
            marks = F.transform(rows, lambda r, i: marked(r, F.array_position(ns, i) - 1))
            text = let(marks, lambda ms: F.array_join(F.flatten(F.transform(F.split(c, pattern), lambda b, i: F.array(b, F.coalesce(F.get(ms, i), F.lit(""))))), ""))
            return F.struct(text.alias("text"), F.filter(rows, lambda r: r["counts"]).alias("found"))

        return let(counts, put)

    return let(told(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), numbered)


def pictures(c: Column) -> Column:
    """(text, found): pictures as markers [img0: description], and (alt, url) of each; icons, repeated pictures and nameless ones that are no picture file go."""

    def told(ms: Column) -> Column:
        parts = F.transform(ms, lambda m: F.struct(strip(F.regexp_extract(m, PICTURE, 1)).alias("alt"), strip(F.regexp_extract(m, PICTURE, 2)).alias("url")))
        icon = lambda r: F.exists(F.array(*map(F.lit, ICONS)), lambda p: F.contains(r["url"], p))
        seen = lambda rs: F.transform(rs, lambda r: F.when((r["url"] != "") & ~icon(r) & ~F.startswith(F.lower(r["alt"]), F.lit("misja ai")), r["url"]))
        file = lambda r: F.exists(F.array(*map(F.lit, PICTURES)), lambda e: F.endswith(F.lower(r["url"]), e))
        first = lambda rs, us: F.transform(rs, lambda r, i: F.struct(r["alt"].alias("alt"), r["url"].alias("url"), (F.get(us, i).isNotNull() & (F.array_position(us, r["url"]) == i + 1) & ((r["alt"] != "") | file(r))).alias("counts")))
        return let(parts, lambda rs: let(seen(rs), lambda us: first(rs, us)))

    marked = lambda r, n: F.when(r["counts"], F.concat(F.lit("[img"), n, F.when(r["alt"] != "", F.concat(F.lit(": "), r["alt"])).otherwise(""), F.lit("]")))
    return _replaced(c, PICTURE, told, marked)


def links(c: Column) -> Column:
    """(text, found): links as their words and a marker [link0], and (text, url) of each; links into the portal itself leave only their words, headings and advertisements nothing."""

    def told(ms: Column) -> Column:
        def row(m: Column) -> Column:
            text, url = strip(F.regexp_extract(m, LINK, 1)), strip(F.substring_index(F.regexp_extract(m, LINK, 2), '"', 1))
            own = F.exists(F.array(*map(F.lit, INTERNAL)), lambda p: F.regexp(url, p))
            words = own | F.startswith(figures(text), F.lit("**0** ###")) | F.contains(text, F.lit("Więcej w Strefie Premium")) | F.startswith(figures(text), F.lit("[img0"))
            gone = (text == "") | (~words & (F.startswith(text, F.lit("## ")) | F.startswith(text, F.lit("### ")) | (F.length(url) > LONG_URL)))
            return F.struct(text.alias("text"), url.alias("url"), (~words & ~gone).alias("counts"), (~gone).alias("stays"))

        return F.transform(ms, row)

    return _replaced(c, LINK, told, lambda r, n: F.when(r["counts"], F.concat(r["text"], F.lit(" [link"), n, F.lit("]"))).when(r["stays"], r["text"]))


def captioned(rows: Column, found: Column) -> Column:
    """Pictures with caption and category: what captions() lists right behind a picture's marker; null where nothing does."""
    number = lambda r: F.regexp_extract(r["text"], r"^\[img(\d+)(: *[^\]]*)?\]$", 1).try_cast("int")
    said = F.filter(F.transform(rows, lambda r, i: F.struct(number(F.get(rows, i - 1)).alias("n"), F.when(i > 0, r["text"]).alias("text"), r["category"].alias("category"), F.coalesce(F.get(rows, i - 1)["category"] == "image_marker", F.lit(False)).alias("below"))), lambda e: e["below"] & (e["category"] != "image_marker") & e["n"].isNotNull())

    def attached(es: Column) -> Column:
        last = lambda i: F.try_element_at(F.filter(es, lambda e: e["n"] == i), F.lit(-1))
        return F.transform(found, lambda r, i: F.struct(r["alt"].alias("alt"), r["url"].alias("url"), last(i)["text"].alias("caption"), last(i)["category"].alias("category")))

    return let(said, attached)


def without_captions_told(c: Column, rows: Column) -> Column:
    """A text without lines that tell a picture's origin, that repeat its description right below it, or that stand between the two."""
    marker = lambda i: F.coalesce(F.get(rows, i)["category"] == "image_marker", F.lit(False))
    repeats = lambda i: F.coalesce((F.get(rows, i)["category"] == "image_description") & ~F.startswith(F.get(rows, i)["text"], F.lit("[img")), F.lit(False))
    near = lambda i: repeats(i) & (marker(i - 1) | (~marker(i - 1) & marker(i - 2)))
    between = lambda i: ~marker(i) & marker(i - 1) & repeats(i + 1)
    gone = F.filter(F.transform(rows, lambda r, i: F.when(r["category"].isin(*ORIGINS) | near(i) | between(i), r["line_index"])), lambda x: x.isNotNull())
    return let(gone, lambda g: F.array_join(F.filter(F.transform(F.split(c, r"\r?\n"), lambda x, i: F.when(~F.array_contains(g, i), x)), lambda x: x.isNotNull()), "\n"))


def own_tags(line: Column) -> Column:
    """Two or more links side by side and nothing else, all into the portal's own tags."""
    urls = F.transform(F.regexp_extract_all(line, F.lit(r"\[[^\]\n]+\]\(([^)\n]+)\)"), F.lit(1)), lambda u: strip(F.substring_index(u, '"', 1)))
    own = lambda u: F.exists(F.array(*map(F.lit, INTERNAL)), lambda p: F.regexp(u, p))
    return (F.size(urls) > 1) & (strip(F.regexp_replace(line, r"\[[^\]\n]+\]\(([^)\n]+)\)", "")) == "") & F.forall(urls, own)


def known_markers(c: Column, n: Column) -> Column:
    """Without markers of pictures that aren't there."""
    orphan = r"\[img\d+(?::[^\]]*)?\]"
    stay = F.transform(F.regexp_extract_all(c, F.lit(orphan), F.lit(0)), lambda m: F.when(F.regexp_extract(m, r"(\d+)", 1).try_cast("int") < n, m).otherwise(""))
    return let(stay, lambda ms: F.array_join(F.flatten(F.transform(F.split(c, orphan), lambda b, i: F.array(b, F.coalesce(F.get(ms, i), F.lit(""))))), ""))


#: Lines of one portal in markdown whose links were taken out before: whole, by their beginning, and, indented, by what follows the indent.
NOISE_WHOLE = ("Kontynuuj czytanie od miejsca, w którym skończyłeś.", "## Zobacz również", " * Dużo czytania, a mało czasu? Sprawdź skrót artykułu")
NOISE_BEGINS = ("**CZYTAJ WIĘCEJ:", "**Zobacz także:**", " * **Przeczytaj:**", " * **Przeczytaj także:**", " * **Czytaj więcej:**", " * **Zobacz:**", " * **Zobacz także:**", " * **Zobacz również:**")
NOISE_INDENTED = ("* **Tekst publikujemy dzięki uprzejmości serwisu", "* link[0]:")
VIDEO, ADVERT = "Dalszy ciąg materiału pod wideo", "reklama"


def without_markdown_noise(c: Column) -> Column:
    """Markdown without a portal's pointers to other articles, which leave empty lines, and without advertisement lines and the empty lines around them.

    Bold lines and second-level headings get an empty line before them, but for the first line. A bold beginning of a list item goes,
    the rest of the item stays. A last line end goes; null stays null.
    """
    any_of = lambda values, test: F.exists(F.array(*map(F.lit, values)), test)

    def gone(x: Column) -> Column:
        indented = x.rlike(r"^\s") & any_of(NOISE_INDENTED, lambda v: F.startswith(figures(F.ltrim(x, F.lit(SPACE_CHARS))), v))
        return F.rtrim(x, F.lit(SPACE_CHARS)).isin(*NOISE_WHOLE) | any_of(NOISE_BEGINS, lambda v: F.startswith(x, v)) | indented | (strip(x) == VIDEO)

    def line(x: Column, i: Column) -> Column:
        apart = (i > 0) & ((F.startswith(x, F.lit("**")) & F.endswith(x, F.lit("**"))) | F.startswith(x, F.lit("## ")))
        kept = F.when(gone(x), "").otherwise(F.regexp_replace(x, r"^\* \*\*.*?\*\*", ""))
        return F.when(apart, F.array(F.lit(""), kept)).otherwise(F.array(kept))

    text = F.array_join(F.flatten(F.transform(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"), line)), "\n")
    return F.regexp_replace(F.regexp_replace(text, rf"(?m)^\s*{ADVERT}\s*\n", ""), rf"\s*{ADVERT}\s*\z", "")
