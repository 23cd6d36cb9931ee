"""Captions of pictures: credits, and the lines right below a picture's marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import let
from .portal import CAPTION, credit_kind, spoken
from .text import fold, strip
from .urls import host

#: Fixed value: the sites whose publisher owns the agency that AGENCY tells.
AGENCY = r" agencj\w* wyborcz\w* "
OWN_SITES = ("wyborcza.pl", "gazeta.pl", "wyborcza.biz", "wysokieobcasy.pl", "tokfm.pl")
#: Lines below a marker that may belong to the picture, and the length of one that repeats its description.
BELOW, DESCRIPTION = 3, 300


def _free(line: Column, site: Column) -> Column:
    said = spoken(line)
    own = F.exists(F.array(*map(F.lit, OWN_SITES)), lambda d: (site == d) | F.endswith(site, F.concat(F.lit("."), d)))
    holds = lambda *values: F.exists(F.array(*[F.lit(f" {v} ") for v in values]), lambda v: F.contains(said, v))
    return F.when(holds("domena publiczna"), "public_domain").when(holds("cc by", "creative commons"), "creative_commons").when(holds("archiwum prywatne"), "own_or_private_archive").when(said.rlike(AGENCY), F.when(own, "own_or_private_archive").otherwise("agency"))


def captions(c: Column, url: Column | None = None) -> Column:
    """(line_index, text, category) of picture markers and captions of a text, in order.

    A line is a caption if it is a credit, or if it stands within three filled lines below a marker like [img3: what it shows],
    is no heading and is short or repeats that description. What follows a repeated description, or a line that is no caption,
    is no longer below the marker. A marker of another form is a description of its own. Pictures of an agency are the site's own
    where its publisher owns the agency.
    """
    site = host(url) if url is not None else F.lit("")

    def kinds(t: Column, i: Column) -> Column:
        whole = r"^\[img\d+(:[^\]]*)?\]$"
        free = F.when(F.length(t) <= CAPTION, _free(t, site))
        return F.struct(
            i.alias("i"),
            t.alias("t"),
            F.when(F.length(t) <= DESCRIPTION, fold(t)).alias("folded"),
            F.startswith(t, F.lit("[img")).alias("marker"),
            t.rlike(whole).alias("whole"),
            F.when(t.rlike(whole), fold(F.regexp_extract(t, r"^\[img\d+:?([^\]]*)\]$", 1))).alias("alt"),
            F.coalesce(free, credit_kind(t)).alias("credit"),
            ((F.length(t) <= CAPTION) & ~F.startswith(t, F.lit("#"))).alias("short"),
        )

    def told(rows: Column) -> Column:
        def of(r: Column, k: Column) -> Column:
            repeats = lambda x, m: (m["alt"] != "") & F.coalesce(x["folded"] == m["alt"], F.lit(False))
            goes_on = lambda x, m: ~x["marker"] & ~repeats(x, m) & (x["credit"].isNotNull() | x["short"])

            def below(d: int) -> Column:
                m = F.get(rows, k - d)
                steps = [goes_on(F.get(rows, k - e), m) for e in range(1, d)]
                here = m["whole"]
                for s in steps:
                    here = here & s
                fits = r["short"] | (repeats(r, m) & (F.length(r["t"]) <= DESCRIPTION) & ~F.startswith(r["t"], F.lit("#")))
                return F.when(F.coalesce(here & fits, F.lit(False)), F.when(repeats(r, m), "image_description").otherwise("image_credit"))

            adjacent = F.coalesce(*[below(d) for d in range(1, BELOW + 1)])
            kind = F.coalesce(F.nullif(r["credit"], F.lit("other")), adjacent, r["credit"])
            row = lambda x: F.struct(r["i"].alias("line_index"), r["t"].alias("text"), x.alias("category"))
            marked = F.when(r["whole"], F.array(row(F.lit("image_marker")))).otherwise(F.array(row(F.lit("image_marker")), row(F.lit("image_description"))))
            return F.when(r["marker"], marked).when(kind.isNotNull(), F.array(row(kind))).otherwise(F.array().cast("array<struct<line_index:int,text:string,category:string>>"))

        return F.flatten(F.transform(rows, of))

    filled = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x, i: F.struct(i.alias("i"), strip(x).alias("t"))), lambda r: r["t"] != "")
    return let(F.transform(filled, lambda r: kinds(r["t"], r["i"])), told)


def without_captions(c: Column) -> Column:
    """The text without markers and captions."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r?\n")
    return let(F.transform(captions(c), lambda x: x["line_index"]), lambda gone: F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n"))
