"""Edits as table transforms: each takes the tables as they are and gives them as they are afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.urls import canonical_url, registrable_domain


def set_authors(links: DataFrame, names: DataFrame) -> DataFrame:
    """links (document_id, name, role, position) with the author links of the documents in names (document_id, names) replaced: in order, the first of names that fold alike. An empty list leaves none; other roles stay."""
    listed = names.select("document_id", F.posexplode("names").alias("at", "name")).where(F.trim("name") != "")
    first = listed.groupBy("document_id", fold(F.col("name")).alias("key")).agg(F.min(F.struct("at", "name")).alias("f"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("f.at"))
    fresh = first.select("document_id", F.trim("f.name").alias("name"), F.lit("author").alias("role"), order.cast("long").alias("position"))
    old = links.where("role <> 'author'").unionByName(links.where("role = 'author'").join(names.select("document_id"), "document_id", "left_anti"))
    return old.select("document_id", "name", "role", "position").unionByName(fresh)


def without_documents(derived: dict[str, DataFrame], opened: DataFrame) -> dict[str, DataFrame]:
    """Derived tables without the rows of documents that are opened for editing again."""
    return {name: df.join(opened.select("document_id"), "document_id", "left_anti") for name, df in derived.items()}


def renamed(entities: DataFrame, aliases: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities (id, name) under new names from changes (id, name), and aliases (id, name) with each old name that the new one doesn't fold to, once."""
    new = changes.select("id", F.col("name").alias("to"))
    joined = entities.join(new, "id", "left")
    old = joined.where(F.col("to").isNotNull() & (fold(F.col("to")) != fold(F.col("name")))).select("id", "name")
    return joined.select("id", F.coalesce("to", "name").alias("name")), aliases.select("id", "name").unionByName(old).distinct()


def merged_publishers(publishers: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, survivor): publishers (id, domain) of one registrable domain go to the one that owns it, else the one of most documents (publisher_id), else the least id."""
    n = documents.groupBy(F.col("publisher_id").alias("id")).agg(F.count("*").alias("n"))
    site = publishers.withColumn("site", registrable_domain(F.concat(F.lit("https://"), F.col("domain")))).join(n, "id", "left")
    best = F.max(F.struct((F.col("domain") == F.col("site")).alias("own"), F.coalesce("n", F.lit(0)).alias("n"), (-F.col("id")).alias("m")))
    survivors = site.groupBy("site").agg((-best["m"]).alias("survivor"))
    return site.join(survivors, "site").select("id", "survivor")


def missing_publishers(urls: DataFrame, publishers: DataFrame) -> DataFrame:
    """Registrable domains of urls that no publisher (domain) has yet, each once."""
    return urls.select(registrable_domain(F.col("url")).alias("domain")).where("domain <> ''").distinct().join(publishers.select("domain"), "domain", "left_anti")


def by_url(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (ask, url) with the least id of the stored (id, url) of the same canonical address, null if there is none."""
    known = stored.groupBy(canonical_url(F.col("url")).alias("key")).agg(F.min("id").alias("id"))
    return asked.select("ask", canonical_url(F.col("url")).alias("key")).join(known, "key", "left").select("ask", "id")


def first_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (id, type, key, author) with the first rule (position, type, key, author, target) of their type and key in list order: global ones, and those of the same author."""
    r = rules.select(F.col("type").alias("t"), F.col("key").alias("k"), F.col("author").alias("a"), "position", "target")
    on = (F.col("type") == F.col("t")) & (F.col("key") == F.col("k")) & (F.col("a").isNull() | (F.col("a") == F.col("author")))
    hit = rows.join(r, on).groupBy("id").agg(F.min(F.struct("position", "target"))["target"].alias("target"))
    return rows.join(hit, "id", "left").select("id", "target")


def prioritised(documents: DataFrame, order: list[Column], counts: DataFrame, key: str, n: int) -> DataFrame:
    """The next n documents: those of the sources with most documents first, then in the given order."""
    return documents.join(counts, key, "left").orderBy(F.desc(F.coalesce("trust", F.lit(0))), *order).limit(n)


def replaced_vectors(vectors: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """vectors (document_id, model, part, vector) without those of the pairs (document_id, model) of gone or fresh, and with fresh. A null model in gone drops a document's vectors of every model."""
    every = gone.where("model IS NULL").select("document_id").distinct()
    pairs = gone.select("document_id", "model").unionByName(fresh.select("document_id", "model")).distinct()
    return vectors.join(every, "document_id", "left_anti").join(pairs, ["document_id", "model"], "left_anti").select(*fresh.columns).unionByName(fresh)


def without_stage(jobs: DataFrame, errors: list[str], waiting: str, next_state: str, review: str) -> DataFrame:
    """jobs (state, error, ...) as they are once a stage is no more: failed ones with its errors go to review, its errors are NONE everywhere, and what waited for it goes on."""
    hers = F.col("error").isin(*errors)
    state = F.when((F.col("state") == "ERROR") & hers, review).when(F.col("state") == waiting, next_state).otherwise(F.col("state"))
    return jobs.select(*[state.alias(c) if c == "state" else F.when(hers, "NONE").otherwise(F.col("error")).alias(c) if c == "error" else F.col(f"`{c}`") for c in jobs.columns])


def marked_reviewed(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """lines (id, status, note, reference) after marks (id, status, note, reference): pending ones take a mark's values, others and those without a mark stay. A mark counts once; of several the least does.

    Rejected marks, of lines that are missing or not pending, are rejected_marks().
    """
    one = marks.groupBy("id").agg(F.min(F.struct("status", "note", "reference")).alias("m"))
    taken = F.col("m").isNotNull() & (F.col("status") == "pending")
    return lines.join(one, "id", "left").select(*[F.when(taken, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "note", "reference") else F.col(f"`{c}`") for c in lines.columns])


def rejected_marks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, reason) of marks that name no line (missing) or one that was decided before (its status)."""
    told = marks.select("id").distinct().join(lines.select("id", F.col("status").alias("was")), "id", "left")
    return told.where("was IS NULL OR was <> 'pending'").select("id", F.coalesce("was", F.lit("missing")).alias("reason"))
