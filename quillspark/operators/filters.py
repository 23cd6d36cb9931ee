"""The one filter model that listings and both search legs share."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, fold

FIRST_YEAR, LAST_YEAR = -5000, 3000


@dataclass(frozen=True)
class SearchFilters:
    """All set fields must hold. Ranges are inclusive; a null column never matches a range."""

    author_name: str | None = None
    publisher_name: str | None = None
    publisher_domain: str | None = None
    discovery_source: str | None = None
    collection: str | None = None
    published_from: date | None = None
    published_to: date | None = None
    ingested_from: datetime | None = None
    ingested_to: datetime | None = None
    period_start: int | None = None
    period_end: int | None = None
    document_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    without_embedding: bool = False
    source_layer: str | None = None

    def __post_init__(self) -> None:
        for low, high in (("published_from", "published_to"), ("ingested_from", "ingested_to"), ("period_start", "period_end")):
            a, b = getattr(self, low), getattr(self, high)
            if a is not None and b is not None and a > b:
                raise ValueError(f"{low} is after {high}")
        for year in (self.period_start, self.period_end):
            if year is not None and not FIRST_YEAR <= year <= LAST_YEAR:
                raise ValueError(f"year {year} is out of range")
        if self.source_layer not in (None, "managed", "notes"):
            raise ValueError(f"unknown layer {self.source_layer}")

    @property
    def empty(self) -> bool:
        return all(getattr(self, f.name) == f.default for f in fields(self))


def escape_like(text: str) -> str:
    """A literal as a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def overlaps(start: Column, end: Column, low: int | None, high: int | None) -> Column:
    """Interval overlap; a null bound on either side is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (end.isNull() | (end >= low))
    if high is not None:
        out = out & (start.isNull() | (start <= high))
    return out


def folded_name(name: str) -> str:
    """A name that one asks for, as `fold` has the names of a table."""
    return " ".join(name.translate(str.maketrans(MARKED, PLAIN)).lower().split())


def site_of(domain: str) -> str:
    """A domain that one asks for, in lower case, without scheme, path, port, final dots and a leading `www.`; of an address that can't be read the empty one."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", domain.strip().lower())
    host = re.sub(r"[/?#].*$", "", host).rpartition("@")[2]
    return re.sub(r":\d*$", "", host).rstrip(".").removeprefix("www.")


def named(table: DataFrame, column: str, name: str) -> DataFrame:
    """All rows of a lookup whose name is the one asked for, whatever its case, marks and spaces: a name that several rows have stands for each of them."""
    return table.where(fold(F.col(column)) == folded_name(name))


def apply_filters(
    docs: DataFrame,
    filters: SearchFilters,
    *,
    authors: DataFrame | None = None,
    aliases: DataFrame | None = None,
    periods: DataFrame | None = None,
    embeddings: DataFrame | None = None,
    publishers: DataFrame | None = None,
    publisher_domains: DataFrame | None = None,
    discovery_sources: DataFrame | None = None,
    collections: DataFrame | None = None,
) -> DataFrame:
    """Filters documents (column id and whichever others the filters name) before any limit.

    Conditions on other tables are semi and anti joins: authors(document_id, name, and person_id if there are aliases), aliases(person_id, alias),
    periods(document_id, start_year, end_year), embeddings(document_id). Names are looked up where a lookup is given:
    publishers(id, name) and publisher_domains(publisher_id, domain) by publisher_id, discovery_sources(id, name) by discovery_source_id,
    collections(id, name) by collection_id; collections go by their exact name. A name that a lookup doesn't have matches nothing.
    """
    looked_up = [
        (filters.publisher_name, publishers, "publisher_id", lambda t, v: named(t, "name", v).select("id")),
        (filters.publisher_domain, publisher_domains, "publisher_id", lambda t, v: t.where(F.lower("domain") == site_of(v)).select(F.col("publisher_id").alias("id"))),
        (filters.discovery_source, discovery_sources, "discovery_source_id", lambda t, v: named(t, "name", v).select("id")),
        (filters.collection, collections, "collection_id", lambda t, v: t.where(F.col("name") == v).select("id")),
    ]
    for value, table, column, ids in looked_up:
        if value and table is not None:
            docs = docs.join(ids(table, value).select(F.col("id").alias(column)), column, "left_semi")
    scalar = [
        (filters.published_from, lambda v: F.col("published_on") >= F.lit(v)),
        (filters.published_to, lambda v: F.col("published_on") <= F.lit(v)),
        (filters.ingested_from, lambda v: F.col("ingested_at") >= F.lit(v)),
        (filters.ingested_to, lambda v: F.col("ingested_at") <= F.lit(v)),
        (filters.document_types, lambda v: F.col("document_type").isin(*v)),
        (filters.languages, lambda v: F.col("language").isin(*v)),
        (discovery_sources is None and filters.discovery_source, lambda v: F.col("discovery_source") == v),
        (collections is None and filters.collection, lambda v: F.col("collection") == v),
        (publisher_domains is None and filters.publisher_domain, lambda v: F.col("publisher_domain") == site_of(v)),
        (filters.source_layer, lambda v: (F.col("document_type") == "note") == F.lit(v == "notes")),
    ]
    for value, condition in scalar:
        if value:
            docs = docs.where(condition(value))
    if filters.author_name:
        docs = docs.join(author_match(docs, authors, filters.author_name, aliases), "id", "left_semi")
    if filters.period_start is not None or filters.period_end is not None:
        hit = periods.where(overlaps(F.col("start_year"), F.col("end_year"), filters.period_start, filters.period_end))
        docs = docs.join(hit.select(F.col("document_id").alias("id")), "id", "left_semi")
    if filters.without_embedding:
        docs = docs.join(embeddings.select(F.col("document_id").alias("id")), "id", "left_anti")
    return docs


def author_match(docs: DataFrame, authors: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """Ids of documents linked to an author of that name or alias, or, without author links, naming them in the byline; case and marks don't matter."""
    linked = named(authors, "name", name).select(F.col("document_id").alias("id"))
    if aliases is not None:
        persons = named(aliases, "alias", name).select("person_id")
        linked = linked.unionByName(authors.join(persons, "person_id", "left_semi").select(F.col("document_id").alias("id")))
    unlinked = docs.join(authors.select(F.col("document_id").alias("id")), "id", "left_anti")
    return linked.unionByName(unlinked.where(F.contains(fold(F.coalesce("byline", F.lit(""))), F.lit(folded_name(name)))).select("id"))


def split_by_rules(rows: DataFrame, text: str, title: str, prefixes: list[str], patterns: list[str]) -> DataFrame:
    """Adds ignored_by: the first URL prefix, else the first title pattern, that a row meets; null for rows to keep."""
    rules = [F.when(F.startswith(F.col(text), F.lit(p)), F.lit(p)) for p in prefixes] + [F.when(F.col(title).rlike(p), F.lit(p)) for p in patterns]
    return rows.withColumn("ignored_by", F.coalesce(*rules) if rules else F.lit(None).cast("string"))
