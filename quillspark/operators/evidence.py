"""What a document's parts tell of it: its best fragment, its one topic, where names stand, when it was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.captions import captions
from ..functions.review import told_date
from ..functions.text import let


def best_fragment(hits: DataFrame) -> DataFrame:
    """The most similar fragment of each document of hits (document_id, fragment_id, similarity), the first of equals; fragments without similarity don't count."""
    best = F.max_by(F.struct("fragment_id", "similarity"), F.struct(F.col("similarity"), -F.col("fragment_id"))).alias("b")
    return hits.where("similarity IS NOT NULL").groupBy("document_id").agg(best).select("document_id", "b.fragment_id", "b.similarity")


def single_topic(docs: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, summary) of documents (document_id, tags) without tags whose first run (run_id, document_id, status) with one topic chunk has a summary.

    Superseded runs don't count; of a run's chunks (run_id, type, summary) those of type TEMAT do.
    """
    bare = docs.where("tags IS NULL OR tags = ''").select("document_id")
    topics = chunks.where("type = 'TEMAT'").groupBy("run_id").agg(F.count("*").alias("n"), F.first("summary").alias("summary")).where("n = 1")
    live = runs.where("status <> 'superseded'").join(bare, "document_id", "left_semi").join(topics, "run_id")
    first = live.groupBy("document_id").agg(F.min_by(F.struct("summary"), "run_id")["summary"].alias("summary"))
    return first.where("summary <> ''")


def filled_html(docs: DataFrame, captured: DataFrame) -> DataFrame:
    """Documents (document_id, kind, html) with the captured html (document_id, html) where a web page has none; others stay."""
    new = captured.where("html <> ''").select("document_id", F.col("html").alias("new"))
    missing = (F.col("kind") == "webpage") & (F.coalesce("html", F.lit("")) == "")
    return docs.join(new, "document_id", "left").select("document_id", "kind", F.when(missing & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("html")).alias("html"))


def named_or_like(asked: DataFrame, rows: DataFrame, most: int = 1000) -> DataFrame:
    """Rows (name, ...) of each asked name (asked), whatever its case; where no row has it, those whose name holds it.

    Names that no row has are a few misspellings: up to `most` of them are compared with all rows as a broadcast side; more are an error.
    """
    low = asked.select("asked").distinct()
    exact = low.join(rows.withColumn("_key", F.lower("name")), F.lower("asked") == F.col("_key")).drop("_key")
    missing = low.join(rows.select(F.lower("name").alias("_key")), F.lower("asked") == F.col("_key"), "left_anti")
    if missing.limit(most + 1).count() > most:
        raise ValueError(f"over {most} names have no row")
    return exact.unionByName(rows.join(F.broadcast(missing), F.contains(F.lower("name"), F.lower("asked"))).select(*exact.columns))


def published_day(texts: Column, chunks: Column, removed: Column, read_at: Column, sidebar: str) -> Column:
    """The day that a document's texts tell relative to when it was read: the texts in order of trust, then chunks without a sidebar, then removed lines unless one is of a sidebar."""
    told = lambda c: F.get(F.filter(F.transform(c, lambda x: told_date(x, read_at)), lambda d: d.isNotNull()), F.lit(0))
    aside = lambda x: F.coalesce(x.rlike(sidebar), F.lit(False))
    return F.coalesce(told(texts), told(F.filter(chunks, lambda x: ~aside(x))), F.when(~F.exists(removed, aside), told(removed)))


def mentions_by_chapter(chapters: DataFrame, names: DataFrame) -> DataFrame:
    """(document_id, position, name, mentions) of a document's names (document_id, name) in its chapters (document_id, position, text), as whole words in any case; none where a name isn't."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.replace(F.col("name"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    held = chapters.join(names.where("name <> ''").select("document_id", "name").distinct(), "document_id")
    return held.select("document_id", "position", "name", F.regexp_count("text", quoted).cast("long").alias("mentions")).where("mentions > 0")


#: What each origin of a picture costs a document, and the most that all together do.
ORIGIN_PENALTIES = {"own_or_private_archive": 0, "agency": 1, "creative_commons": 2, "public_domain": 2, "stock": 3, "illustrative": 3, "image_credit": 2, "other": 2}
MOST_PENALTY = 15


def photo_sources(documents: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, stored, captions, penalty, by_category) of documents (document_id, text, url) from images (document_id, category).

    Stored pictures tell the origin where a document has any, also if none of them has a category; the text's captions are read
    only for documents without. by_category maps each category with a penalty to the sum of it; penalty is their sum, at most
    MOST_PENALTY. Pictures are counted by document and category before they meet the documents, and texts never shuffle with them
    but for that one join.
    """
    cost = F.create_map(*[F.lit(x) for pair in ORIGIN_PENALTIES.items() for x in pair])
    counted = images.groupBy("document_id", "category").agg(F.count("*").alias("n"))
    told = counted.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("category").isin(*ORIGIN_PENALTIES), F.struct("category", "n"))))).alias("of_images"))
    kinds = F.array(*map(F.lit, sorted(ORIGIN_PENALTIES)))
    here = F.transform(captions(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))), lambda r: r["category"])
    of_text = let(here, lambda cs: F.map_from_entries(F.filter(F.transform(kinds, lambda k: F.struct(k.alias("category"), F.size(F.filter(cs, lambda c: c == k)).cast("long").alias("n"))), lambda e: e["n"] > 0)))
    rows = documents.join(told, "document_id", "left").withColumn("found", F.when(F.col("of_images").isNotNull(), F.col("of_images")).otherwise(of_text))
    costs = F.map_filter(F.transform_values("found", lambda k, n: n * cost[k]), lambda k, n: n > 0)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("document_id", F.col("of_images").isNotNull().alias("stored"), total(F.col("found")).alias("captions"), F.least(F.lit(MOST_PENALTY), total(costs)).alias("penalty"), costs.alias("by_category"))
