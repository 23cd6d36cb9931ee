"""Links inside texts, and corrections of groups with their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, let

#: What a link in running text is made of, and the marks at its end that belong to the sentence.
LINK = r"https?://[^\s<>\"']+"
CLOSING = r"[.,;:!?)\]}]+$"


def rewrite_links(docs: DataFrame, targets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with each link of their texts replaced by its target, where targets (url, target) has one. Marks that close a sentence after a link stay.

    Links leave their texts as narrow rows with their positions, meet their targets, and return as one small map a text; only texts with
    a known link are touched. Rows are told apart by key and text, so a key may be null or repeated. Null texts stay null.
    Of several targets of a link the least is taken.
    """
    one = targets.groupBy(F.col("url").alias("__url")).agg(F.min("target").alias("__target"))
    places = docs.where(F.col(text).contains("://")).select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), F.posexplode(F.regexp_extract_all(text, F.lit(LINK), F.lit(0))).alias("__pos", "__link")).distinct()
    known = places.withColumn("__url", F.regexp_replace("__link", CLOSING, "")).join(one, "__url")
    closing = F.substring("__link", F.length("__url") + 1, F.length("__link"))
    found = known.groupBy("__key", "__hash").agg(F.map_from_entries(F.collect_list(F.struct("__pos", F.concat("__target", closing)))).alias("__new"))
    joined = docs.join(found, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(docs[text]) == F.col("__hash")), "left")
    put = lambda links: F.array_join(F.transform(F.split(text, LINK), lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at("__new", i), F.get(links, i), F.lit("")))), "")
    out = F.when(F.col("__new").isNull(), docs[text]).otherwise(let(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), put))
    return joined.select(*[out.alias(c) if c == text else docs[c] for c in docs.columns])


def _keys(text: Column, *more: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(text), *[F.coalesce(m, F.array().cast("array<string>")) for m in more]), fold), lambda x: x != ""))


def apply_corrections(groups: DataFrame, rules: DataFrame, store, own_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, audit): entity groups after the approved rules, and a row for each rule that changed one.

    groups: doc, author, type, text, count, variants, lemmas. rules: rule (order), match_type (`*`: any), lemma, scope (global or author), author, new_type
    (null: as before), new_text. A rule meets a group by its text, a lemma or a variant, folded; both kinds of places are one
    type. The first rule by order wins, with own_first those of the author before global ones. Groups that come to the same type and text
    are merged: counts are added, variants and lemmas united. A rule that changes nothing leaves no audit row.
    store(df) keeps the decisions (a checkpoint or a table), so both results come from one pass.
    """
    places = lambda c: F.when(c.isin("geogName", "placeName"), F.lit("place")).otherwise(c)
    known = rules.select("rule", F.col("match_type").alias("m_type"), fold(F.col("lemma")).alias("m_key"), "scope", fold(F.coalesce("author", F.lit(""))).alias("m_author"), "new_type", "new_text").where("m_key <> ''")
    numbered = groups.select("doc", "type", "text", fold(F.coalesce("author", F.lit(""))).alias("g_author"), F.explode(_keys(F.col("text"), F.col("lemmas"), F.col("variants"))).alias("m_key"))
    fits = (F.col("m_type") == "*") | (places(F.col("m_type")) == places(F.col("type")))
    own = (F.col("scope") == "author") & (F.col("g_author") != "") & (F.col("g_author") == F.col("m_author"))
    met = numbered.join(known, "m_key").where(fits & ((F.col("scope") == "global") | own))
    order = F.struct(*([F.when(own, 0).otherwise(1).alias("shared")] if own_first else []), "rule", "new_type", "new_text")
    chosen = met.groupBy(F.col("doc").alias("d"), F.col("type").alias("ty"), F.col("text").alias("tx")).agg(F.min(order).alias("won"))
    on = F.col("doc").eqNullSafe(F.col("d")) & F.col("type").eqNullSafe(F.col("ty")) & F.col("text").eqNullSafe(F.col("tx"))
    decided = groups.join(chosen, on, "left").select(*groups.columns, "won.rule", F.coalesce("won.new_type", "type").alias("type_after"), F.coalesce("won.new_text", "text").alias("text_after"))
    decided = store(decided)
    changed = F.col("rule").isNotNull() & ((F.col("type") != F.col("type_after")) | (F.col("text") != F.col("text_after")))
    audit = decided.where(changed).select("doc", "rule", F.col("type").alias("type_before"), F.col("text").alias("text_before"), "type_after", "text_after")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    after = decided.groupBy("doc", F.col("type_after").alias("type"), F.col("text_after").alias("text")).agg(F.min("author").alias("author"), F.sum("count").alias("count"), united(F.col("variants")).alias("variants"), united(F.col("lemmas")).alias("lemmas"))
    return after, audit
