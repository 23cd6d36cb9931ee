"""Text, date and chunk functions against cases and plain Python versions."""

import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chunking as C
from quillspark.functions import dates as D
from quillspark.functions import text as T
from quillspark.functions import urls as U
from quillspark.operators.filters import SearchFilters


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("v")).first()["v"]


def packed(parts, limit, room):
    """Greedy packing in plain Python, as (chunk lengths rule) reference for the fold."""
    out, now, size = [], [], 0
    for p in parts:
        if len(p) > limit:
            if now:
                out.append(now)
            now, size = [], 0
            out += [[p[i : i + limit]] for i in range(0, len(p), limit)]
        elif now and size + len(p) + room > limit:
            out.append(now)
            now, size = [p], len(p)
        else:
            now.append(p)
            size += len(p) + room
    return out + ([now] if now else [])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc ", min_size=1, max_size=40).map(lambda s: s.strip() + "."), max_size=12))
def test_sentence_chunks(spark, sentences):
    text = " ".join(sentences)
    found = value(spark, lambda c: C.sentence_chunks(c, 50), text)
    parts = [p.strip() for p in re.split(r"(?<=[.!?…])\s+", re.sub(" {2,}", " ", text)) if p.strip()]
    want = ["\n".join(p) for p in packed(parts, 50, 1)]
    if len(want) > 1 and len(want[-1]) < 7.5:
        want[-2:] = [want[-2] + "\n" + want[-1]]
    assert found == want


def test_paragraphs_and_sections(spark):
    assert value(spark, lambda c: C.paragraph_chunks(c, 20), "one\n\ntwo\n\n" + "x" * 12 + "\n" + "y" * 12) == ["one\n\ntwo", "x" * 12, "y" * 12]
    assert value(spark, lambda c: C.markdown_chunks(c, 30), "intro\n# A\nbody of a\n## B\nbody of section b") == ["intro\n\n# A\nbody of a", "## B\nbody of section b"]
    assert value(spark, lambda c: C.markdown_chunks(c, 30), "") == []


def test_chapters(spark):
    found = value(spark, C.chapters, "front\n# One #\na\n# Two\nb")
    assert [(c["position"], c["level"], c["title"]) for c in found] == [(1, 1, "(wstęp)"), (2, 1, "One"), (3, 1, "Two")]
    assert [c["title"] for c in value(spark, C.chapters, "# Book\n## One\nx\n## Two\ny")] == ["(wstęp)", "One", "Two"]
    assert value(spark, C.chapters, "no headings") == []


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/a/?utm_source=x&b=2&a=1#f", "http://example.com/a?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://youtu.be/abc?t=3", "https://www.youtube.com/watch?v=abc"),
        ("https://m.youtube.com/watch?v=abc&list=q", "https://www.youtube.com/watch?v=abc"),
        ("https://example.com:8443/x/", "https://example.com:8443/x"),
        ("not a url#frag", "not a url"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, U.canonical_url, url) == want


def test_domains_and_html(spark):
    assert value(spark, U.registrable_domain, "https://a.b.example.co.uk/x") == "example.co.uk"
    assert value(spark, U.registrable_domain, "https://a.example.com") == "example.com"
    assert value(spark, U.strip_html, "<p>A &amp; B</p><script>x</script>c<br>d") == "A & B\nc\nd"


def test_text(spark):
    assert value(spark, T.author_names, "Jan Nowak, jan nowak; Redakcja / Ewa Lis i Adam Żak") == ["Jan Nowak", "Ewa Lis", "Adam Żak"]
    assert value(spark, T.fold, "  Łódź  ŻABA ") == "lodz zaba"
    assert value(spark, lambda c: T.cut_from_last(c, "x+"), "a x b xx c") == "a x b "
    assert value(spark, lambda c: T.speakers(c, "A", "B"), ">> one >> two") == "B: one\nA: two"
    assert value(spark, T.is_clickbait, "Nie uwierzysz, co") and not value(spark, T.is_clickbait, None)
    assert value(spark, T.search_terms, "- One, one; 2. two\n" + "x" * 81) == ["One", "two"]
    assert value(spark, T.without_fillers, "well um, the the cat  sat") == "well the cat sat"


@pytest.mark.parametrize(
    ("phrase", "precision", "year", "start", "end"),
    [
        ("12 maja 1998 r.", "day", 1998, (1998, 5, 12), (1998, 5, 12)),
        ("październik", None, None, None, None),
        ("w lutym i marca 2000", "month", 2000, (2000, 3, 1), (2000, 3, 31)),
        ("XIX wieku", "century", 1850, (1801, 1, 1), (1900, 12, 31)),
        ("lata 80.", "decade", 1980, (1980, 1, 1), (1989, 12, 31)),
        ("1914–1918", "year", 1914, (1914, 1, 1), (1918, 12, 31)),
        ("", None, None, None, None),
    ],
)
def test_date_phrase(spark, phrase, precision, year, start, end):
    found = value(spark, D.date_phrase, phrase)
    assert (found and found["date_precision"]) == precision
    if precision:
        assert (found["sort_year"], found["event_date"], found["event_date_end"]) == (year, datetime.date(*start), datetime.date(*end))


def test_roman_and_cost(spark):
    assert [value(spark, D.roman, x) for x in ("IV", "xix", "MCM")] == [4, 19, 1900]
    cost = spark.range(1).select(D.token_cost(F.lit(1234567), F.lit("0.250001").cast("decimal(12,6)")).alias("v")).first()["v"]
    assert str(cost) == "0.3086429846"  # 0.308642984567 to ten places


def test_filters_are_checked():
    with pytest.raises(ValueError):
        SearchFilters(period_start=2000, period_end=1990)
    with pytest.raises(ValueError):
        SearchFilters(source_layer="other")
    assert SearchFilters().empty and not SearchFilters(languages=("en",)).empty


def test_footnotes_and_lists(spark):
    from quillspark.functions import markup as M

    text = "Body\n1 www.e.com/a\n2 of them\n\n\n\n³ Nowak, Title\n4 Nowak 1999\nEND"
    found = value(spark, M.footnotes, text)
    assert [(f["marker"], f["text"], f["url"]) for f in found] == [("1", "www.e.com/a", "https://www.e.com/a"), ("3", "Nowak, Title", None), ("4", "Nowak 1999", None)]
    assert all(text[f["char_offset"] :].startswith(m) for f, m in zip(found, ("1 www", "³ N", "4 N"), strict=True))
    assert value(spark, M.without_footnotes, text) == "Body\n2 of them\n\nEND"
    assert value(spark, M.is_references, "\n## Bibliografia:\nx") and not value(spark, M.is_references, "")
    assert value(spark, M.blank_markers, "a **b** [img12]c") == "a   b" + " " * 10 + "c"
    assert [s["title"] for s in value(spark, M.sections, "x\n## A \nt\n## B")] == ["A", "B"]
    assert value(spark, M.sender_address, "Ann <A@Example.com>") == "a@example.com" and value(spark, M.sender_address, "x@y") is None


@pytest.mark.parametrize(("name", "want"), [('"Financial Times"', "Financial Times"), ('Hans "Bellingcat', "Hans Bellingcat"), ("Aleksander „Rocky” B", "Aleksander „Rocky” B"), ('""Grot"', "Grot"), ("O'Brien", "O'Brien"), (None, None), ("", "")])
def test_quotes(name, want):
    from quillspark.functions.names import balanced

    assert balanced(name) == want


def test_names(spark):
    from quillspark.functions import names as N

    assert value(spark, lambda c: N.label_matches(c, F.lit("Marine Le Pen")), "Lepen") and not value(spark, lambda c: N.label_matches(c, F.lit("Žemaitė")), "demokratas")
    assert value(spark, N.is_initials, "J. K.") and not value(spark, N.is_initials, "Jan")
    assert value(spark, lambda c: N.preferred_spelling(F.split(c, ",")), "nato,nato,NATO,Nato,Nato") == "Nato"


def test_articles_and_transcripts(spark):
    from quillspark.functions import articles as A
    from quillspark.functions import transcripts as R

    html = '<script type="application/ld+json">[{"@type":"Article","author":[{"name":"A &amp; B"},{"@id":"#x"}]},{"@id":"#x","name":"C"}]</script><meta property="article:published_time" content="2024-05-06T01:02">'
    assert value(spark, A.article_authors, html) == ["A & B", "C"]
    assert value(spark, A.publication_date, html) == datetime.date(2024, 5, 6)
    assert value(spark, A.article_authors, "<html>") == [] and value(spark, A.publication_date, "<html>") is None
    assert value(spark, A.embedded_target, "https://c.e.com/aHR0cHM6Ly9leGFtcGxlLmNvbS94") == "https://example.com/x"
    assert value(spark, A.embedded_target, "https://c.e.com/") is None
    assert value(spark, A.fenced_json, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and value(spark, A.complete_objects, "none") is None
    found = value(spark, R.chapter_list, "intro 0:10\nno time\n1:00:05 - end")
    assert [(c["start"], c["end"], c["title"]) for c in found] == [(10, 3605, "intro"), (3605, R.OPEN_END, "end")]


@pytest.mark.parametrize("table", ["COUNTRIES", "CITIES", "WATERS", "PROVINCES", "REGIONS"])
def test_names_are_their_own(spark, table):
    from quillspark.functions import places as P
    from quillspark.operators.places import canonical_name

    names = getattr(P, table)
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", canonical_name(F.col("name"), names).alias("found"))
    assert [r.name for r in rows.collect() if r.found != r.name] == []


DATED = [("5.04", [(0, "5.04")]), ("a 5.04.2023.7 b", [(2, "5.04.2023")]), ("123.04 5.123 32.1.02", [(16, "1.02")]), ("1-02/99x", [(0, "1-02/99")]), ("12.5.123", [(0, "12.5")]), ("00.1 1.00 1.13", []), ("31.12.01.01", [(0, "31.12.01")]), ("1.2.3.4.5", [(0, "1.2"), (4, "3.4")]), ("", [])]


@pytest.mark.parametrize(("text", "want"), DATED)
def test_dates_in_figures(spark, text, want):
    from quillspark.functions import splitting

    found = spark.range(1).select(splitting.dated_places(F.lit(text)).alias("d")).first().d
    assert [(x.start, x.date) for x in found] == want


MAILS = [("<b>x</b></b> <b class='y'>z</b>", "**x** z"), ("<a href='u'>v</a> <a href=\"u\">v</a> w</a>", "v v (u) w"), ("1 < 2 <p >a</p>", "1 < 2\na"), ("<H2 id=x>T</H2>", "## T"), ("<i><b>x</i></b>", "***x***")]


@pytest.mark.parametrize(("html", "want"), MAILS)
def test_mail_tags(spark, html, want):
    from quillspark.functions import splitting

    assert spark.range(1).select(splitting.mail_text(F.lit(html)).alias("t")).first().t == want
