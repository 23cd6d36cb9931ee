"""Where an article stands in a page's markdown, which portal it is of, what a parsed query asks, which addresses may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import let, sentence_chunks
from .review import ordered
from .text import strip

#: Portals by what their addresses hold, in order; sorts, confidences and layers of a query; lines kept above a heading, letters of a heading that counts.
PORTALS = (
    ("onet.pl", "onet"), ("fakt.pl", "onet"), ("money.pl", "money"), ("wp.pl", "wp"), ("o2.pl", "wp"), ("interia.pl", "interia"), ("businessinsider.com.pl", "businessinsider"),
    ("national-geographic.pl", "natgeo"), ("gazeta.pl", "gazeta"), ("bankier.pl", "bankier"),
)
ABOVE, HEADING = 3, 10
QUERY = "query string, author_name string, publisher_domain string, published_on_from string, published_on_to string, subject_period_start_year int, subject_period_end_year int, document_types array<string>, languages array<string>, sort string"
SORTS = ("relevance", "published_desc", "published_asc", "ingested_desc")


def portal(url: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(url), F.lit(part)), F.lit(name)) for part, name in PORTALS])


def without_navigation(c: Column) -> Column:
    """From three lines above the last first-level heading; without one, the last three fifths of the lines."""

    def of(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("# ")) & (F.length(x) > HEADING), i)), lambda i: i.isNotNull())
        start = F.when(F.size(heads) > 0, F.greatest(F.array_max(heads) - ABOVE, F.lit(0))).otherwise(F.floor(F.size(lines) * 4 / 10).cast("int"))
        return F.array_join(F.slice(lines, start + 1, F.size(lines)), "\n")

    return let(F.split(c, r"\r?\n"), of)


def between(c: Column, first: Column, last: Column, footers: tuple[str, ...] = ()) -> Column:
    """The lines from the first that holds the opening sentence to the line above the first footer, else to the last that holds the closing sentence; null where they aren't there in this order."""
    alike = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def of(lines: Column) -> Column:
        at = lambda test: F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
        holds = lambda said: at(lambda x: (alike(said) != "") & F.contains(alike(x), alike(said)))
        start = F.array_min(holds(first))
        feet = at(lambda x: F.exists(F.array(*map(F.lit, footers)), lambda f: F.startswith(strip(x), f))) if footers else F.array().cast("array<int>")
        end = F.coalesce(F.array_min(F.filter(feet, lambda i: i > start)) - 1, F.array_max(holds(last)))
        filled = F.array_max(F.filter(at(lambda x: strip(x) != ""), lambda i: i <= end))
        return F.when(filled > start, F.array_join(F.slice(lines, start + 1, filled - start + 1), "\n"))

    return let(F.split(c, r"\r?\n"), of)


def chapter_chunks(c: Column, titles: Column, limit: int) -> Column:
    """Chunks that begin where a block opens with a chapter's title, long ones cut at sentences; null where under half of the titles open a block."""
    title = lambda b: F.trim(F.regexp_replace(F.trim(F.substring_index(b, "\n", 1)), r"^#{1,6}\s+", ""))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    flush = lambda a: F.when(a["now"] != "", F.array_append(a["done"], a["now"])).otherwise(a["done"])

    def step(a: Column, b: Column) -> Column:
        more = F.struct(a["done"].alias("done"), F.when(a["now"] == "", b).otherwise(F.concat(a["now"], F.lit("\n\n"), b)).alias("now"))
        return F.when(F.array_contains(titles, title(b)), F.struct(flush(a).alias("done"), b.alias("now"))).otherwise(more)

    def of(blocks: Column) -> Column:
        found = F.size(F.filter(blocks, lambda b: F.array_contains(titles, title(b))))
        chunks = F.aggregate(blocks, empty, step, flush)
        cut = F.flatten(F.transform(chunks, lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(sentence_chunks(x, limit))))
        return F.when((F.size(titles) > 0) & (found >= F.floor((F.size(titles) + 1) / 2)), cut)

    return let(F.split(c, "\n\n"), of)


def may_fetch(url: Column) -> Column:
    """Whether an address may be fetched: http or https, with a host that is no name or number of the own machine or network. Names aren't looked up."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    own = r"^(localhost|.*\.local(host)?|0\..*|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|(22[4-9]|2[3-5]\d)\..*|\[(::1?|f[cd].*|fe[89ab].*)\])$"
    return F.coalesce((host != "") & ~host.rlike(own), F.lit(False))


def parsed_query(payload: Column) -> Column:
    """A model's JSON as a query: days and years in order, lists and sort checked, swapped telling of ranges that were turned, error naming the first field that isn't legal, `response` for what is no JSON object."""
    # broken JSON still yields a struct of nulls, so whether it is an object at all is asked of the variant
    whole = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(payload)), F.lit("OBJECT")), F.lit(False))
    q = F.from_json(payload, QUERY)
    day = lambda name: F.try_to_date(q[name], "yyyy-MM-dd")
    bad_day = lambda name: q[name].isNotNull() & day(name).isNull()
    days, years = ordered(day("published_on_from"), day("published_on_to")), ordered(q["subject_period_start_year"], q["subject_period_end_year"])
    sort = F.coalesce(F.nullif(q["sort"], F.lit("")), F.lit("relevance"))
    error = (
        F.when(~whole, "response")
        .when(bad_day("published_on_from") | bad_day("published_on_to"), "published_on")
        .when(~sort.isin(*SORTS), "sort")
        .when(F.exists(F.coalesce(q["languages"], F.array().cast("array<string>")), lambda x: ~x.rlike("^[a-z]{2}$")), "languages")
    )
    return F.struct(
        F.nullif(F.trim(q["query"]), F.lit("")).alias("query"),
        days["start"].cast("string").alias("published_from"),
        days["end"].cast("string").alias("published_to"),
        years["start"].alias("first_year"),
        years["end"].alias("last_year"),
        F.array_join(q["languages"], ",").alias("languages"),
        sort.alias("sort"),
        (days["swapped"] | years["swapped"]).alias("swapped"),
        error.alias("error"),
    )
