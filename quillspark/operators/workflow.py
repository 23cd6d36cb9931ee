"""Steps between review and search: persons, merges, imports, images, suggestions, vectors, and sources that texts report from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.captions import without_captions
from ..functions.chunking import plain_markdown
from ..functions.splitting import by_headings
from ..functions.text import fold, strip
from .entities import resolve, similar_names
from .models import call_model, hashed_embedding

#: Sources that texts report from, with the forms of their names, and the verbs of a report.
SOURCES = {"AFP": ("AFP", "agencja AFP", "Agence France-Presse"), "France24": ("France24", "France 24"), "The New York Times": ("The New York Times", "New York Times", "NYT")}
VERBS = ("ujawnił", "ujawniła", "ujawniło", "ustalił", "ustaliła", "ustaliło", "podał", "podała", "podało", "opisał", "opisała", "opisało", "donosi", "donosił", "donosiła", "informuje", "poinformował", "poinformowała", "poinformowało", "napisał", "napisała", "napisało")
WORDS_A_PART = 200


def persons(mentions: DataFrame, index: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Mentions (id, name) with the person that an exact name or alias means (index: entity_id, key), else the one name most like it (names: entity_id, name), else for review.

    A name that means several persons goes to review, and so does one that is equally like two.
    """
    told = resolve(mentions, index)
    open_ = told.where("status = 'unknown'").select("name").distinct()
    like = similar_names(open_.select(fold(F.col("name")).alias("name")), names.select(fold(F.col("name")).alias("name")), least)
    whose = like.join(names.select(fold(F.col("name")).alias("other"), F.col("entity_id").alias("like_id")).distinct(), "other")
    rank = F.rank().over(Window.partitionBy("name").orderBy(F.desc("similarity")))
    best = whose.withColumn("k", rank).where("k = 1").groupBy("name").agg(F.count_distinct("like_id").alias("n"), F.min("like_id").alias("like_id")).where("n = 1").select(F.col("name").alias("key"), "like_id")
    out = told.withColumn("key", fold(F.col("name"))).join(best, "key", "left")
    fuzzy = (F.col("status") == "unknown") & F.col("like_id").isNotNull()
    status = F.when(fuzzy, "fuzzy").when(F.col("status") == "resolved", "resolved").otherwise("review")
    return out.select("id", "name", F.when(fuzzy, F.col("like_id")).otherwise(F.col("entity_id")).alias("entity_id"), status.alias("status"))


def merged(entities: DataFrame, aliases: DataFrame, links: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, name), aliases (id, name) and links (document_id, id) after merges (id, target) whose targets stay.

    Links and aliases move to the target, the name of what is merged becomes an alias of it, and doubles go: links by document,
    aliases by folded name.
    """
    to = F.coalesce("target", "id").alias("id")
    moved = lambda df, *columns: df.join(merges, "id", "left").select(*columns, to)
    old = entities.join(merges, "id").select("name", F.col("target").alias("id"))
    spelled = moved(aliases, "name").unionByName(old).withColumn("__key", fold(F.col("name")))
    return entities.join(merges, "id", "left_anti"), spelled.groupBy("id", "__key").agg(F.min("name").alias("name")).drop("__key"), moved(links, "document_id").distinct()


def enriched(entities: DataFrame, **tables: DataFrame) -> DataFrame:
    """Entities (document_id, type, name, mentions) of each document and type as one list by name, each with what its tables (name, value) tell."""
    rows = entities
    for column, table in tables.items():
        rows = rows.join(table.select("name", F.col("value").alias(column)), "name", "left")
    return rows.groupBy("document_id", "type").agg(F.array_sort(F.collect_list(F.struct("name", "mentions", *tables))).alias("items"))


def imported(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items (feed, published_at, ...) that a feed (feed, import_from) takes by itself: published at or after its threshold; feeds without one take none."""
    return items.join(feeds.where("import_from IS NOT NULL"), "feed").where("published_at >= import_from").drop("import_from")


def replaced(old: DataFrame, new: DataFrame, keys: list[str], emptied: DataFrame | None = None) -> DataFrame:
    """Rows of the keys in `new` (and in `emptied`, which get none) replaced; other rows stay."""
    gone = new.select(*keys) if emptied is None else new.select(*keys).unionByName(emptied.select(*keys))
    return old.join(gone.distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def applied_suggestions(links: DataFrame, suggestions: DataFrame, least: float) -> DataFrame:
    """Links (document_id, group_id) with the open suggestions (document_id, group_id, confidence, status) of that confidence or more, each once."""
    sure = suggestions.where((F.col("status") == "open") & (F.col("confidence") >= least)).select("document_id", "group_id").distinct()
    return links.unionByName(sure.join(links, ["document_id", "group_id"], "left_anti"))


def vectors_of_run(chunks: DataFrame, most: int = WORDS_A_PART, model=lambda texts: [hashed_embedding(x) for x in texts]) -> DataFrame:
    """(key, text, embedding, error) of the approved topic chunks (chunk_id, type, status, text): captions go, parts of up to `most` words are cut, markdown goes, and the model sees batches."""
    ready = chunks.where("type = 'TEMAT' AND status = 'approved'").select("chunk_id", F.posexplode(by_headings(without_captions(F.col("text")), most)).alias("position", "part"))
    parts = ready.select(F.concat_ws(":", "chunk_id", "position").alias("key"), strip(plain_markdown(strip(F.col("part")))).alias("text")).where("text <> ''")
    return parts.join(call_model(parts, "key", "text", model, "array<double>").select("key", F.col("result").alias("embedding"), "error"), "key")


def reported_sources(docs: DataFrame, sources: dict[str, tuple[str, ...]] = SOURCES) -> DataFrame:
    """(id, source, mention, evidence): for each text (id, text) and source the first sentence that names the source and holds a verb of reporting."""
    word = lambda alternatives: r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(alternatives) + r")(?![\p{L}\p{N}_])"
    verbs = word(VERBS)
    rows = docs.select("id", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: s.rlike(verbs))).alias("position", "sentence"))
    told = []
    for source, names in sources.items():
        mention = F.coalesce(*[F.when(F.col("sentence").rlike(word([rf"\Q{n}\E"])), F.lit(n)) for n in names])
        told.append(F.struct(F.lit(source).alias("source"), mention.alias("mention")))
    met = rows.select("id", "position", "sentence", F.explode(F.filter(F.array(*told), lambda x: x["mention"].isNotNull())).alias("s"))
    first = F.min_by(F.struct("s.mention", "sentence"), "position").alias("f")
    return met.groupBy("id", F.col("s.source").alias("source")).agg(first).select("id", "source", "f.mention", strip(F.col("f.sentence")).alias("evidence"))


def copied_groups(items: DataFrame, memberships: DataFrame, groups: DataFrame, current: DataFrame, source: str) -> DataFrame:
    """(document_id, group_id, source): memberships that documents get from their feed items, which they don't have yet.

    items: item_id, document_id. memberships: item_id, group_id. groups: group_id, kind (topic or priority), rank, archived. current: document_id,
    group_id. All topics in use are copied; of priorities the one of the least rank, then id, and only where the document has none at all.
    """
    given = items.join(memberships, "item_id").select("document_id", "group_id").distinct().join(groups.where("NOT archived"), "group_id")
    has = current.join(groups.where("kind = 'priority'").select("group_id"), "group_id").select("document_id").distinct()
    best = given.where("kind = 'priority'").join(has, "document_id", "left_anti").groupBy("document_id").agg(F.min(F.struct("rank", "group_id")).alias("b")).select("document_id", "b.group_id")
    wanted = given.where("kind = 'topic'").select("document_id", "group_id").unionByName(best)
    return wanted.join(current.select("document_id", "group_id"), ["document_id", "group_id"], "left_anti").withColumn("source", F.lit(source))


def linked_items(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Feed items (item_id, url, document_id, status) hung on the document (document_id, url) of the same address; those still open become imported. Others stay as they are."""
    known = docs.groupBy("url").agg(F.min("document_id").alias("found"))
    joined = items.join(known, "url", "left")
    open_ = F.col("status").isin("new", "llm_analysis_requested", "saved_for_later", "error")
    return joined.select("item_id", "url", F.coalesce("found", "document_id").alias("document_id"), F.when(F.col("found").isNotNull() & open_, "imported").otherwise(F.col("status")).alias("status"))
