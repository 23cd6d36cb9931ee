"""Names, gazetteers, mentions and document quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def alias_index(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, key) over canonical names and aliases (entity_id, name), folded, each pair once."""
    return names.select("entity_id", fold(F.col("name")).alias("key")).union(aliases.select("entity_id", fold(F.col("name")).alias("key"))).where("key <> ''").distinct()


def resolve(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Mentions (id, name) with how many entities the name means: the entity where it is one, never a pick among several."""
    per_key = index.groupBy("key").agg(F.count("*").alias("candidates"), F.min("entity_id").alias("only"))
    joined = mentions.withColumn("key", fold(F.col("name"))).join(per_key, "key", "left")
    n = F.coalesce("candidates", F.lit(0))
    status = F.when(n == 0, "unknown").when(n == 1, "resolved").otherwise("ambiguous")
    return joined.select("id", "name", F.when(n == 1, F.col("only")).alias("entity_id"), status.alias("status"))


def name_words(c: Column) -> Column:
    """The words of a name in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """The distinct trigrams of each word, padded by two spaces in front and one behind."""
    padded = F.transform(name_words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def subsets(c: Column, k: int) -> Column:
    """All choices of k items of an array of strings, in its order."""
    some = F.aggregate(c, F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < k), lambda s: F.concat(s, F.array(x)))))
    return F.filter(some, lambda s: F.size(s) == k)


def sharing_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, other): all pairs of distinct names (column name on both sides) that can have the similarity `least` (above 0), and few others.

    Such pairs share a key. A set of n trigrams lacks at most e = (1 - least) * n of them in its partner. Where not even the
    largest possible partner, of n / least, leaves room for one, the sets are equal: the key is the whole set. Other sets share
    k trigrams among the rarest e + k of each (prefix filtering), and each choice of k of these is a key. One trigram alone stands
    in a fixed share of all names, so k is greater where the threshold is high and choices are few.

    Joins here are by merge: Spark takes rows of exploded arrays for no more than the names' own, and would send them through the driver.
    """
    k = 3 if least >= 0.9 else 2 if least >= 0.75 else 1
    whole = lambda x: F.floor(x + F.lit(1e-9))
    n, lacks = F.size("grams"), lambda size: whole(size * F.lit(1 - least))
    equal = lacks(whole(n / F.lit(least))) == 0
    sides = [df.select("name").distinct().withColumn("grams", trigrams(F.col("name"))).where(n > 0) for df in (left, right)]
    rows = [df.where(~equal).select("name", F.explode("grams").alias("gram")) for df in sides]
    found = rows[0].union(rows[1]).groupBy("gram").agg(F.count("*").alias("found"))

    def keys(df: DataFrame, exploded: DataFrame) -> DataFrame:
        by_rarity = exploded.join(found.hint("merge"), "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("found", "gram")))["gram"].alias("grams"))
        chosen = by_rarity.select("name", F.explode(subsets(F.slice("grams", 1, (lacks(n) + k).cast("int")), k)).alias("key"))
        return df.where(equal).select("name", F.array_sort("grams").alias("key")).union(chosen).select("name", F.xxhash64("key").alias("key"))

    others = keys(sides[1], rows[1]).withColumnRenamed("name", "other")
    return keys(sides[0], rows[0]).join(others.hint("merge"), "key").select("name", "other")


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct names (column name on both sides) by trigram similarity, shared / (all of both); names that share keys are compared whole."""
    pairs = sharing_names(left, right, least).distinct().withColumns({"g": trigrams(F.col("name")), "h": trigrams(F.col("other"))})
    shared = F.size(F.array_intersect("g", "h"))
    similarity = shared / (F.size("g") + F.size("h") - shared)
    return pairs.select("name", "other", similarity.alias("similarity")).where(F.col("similarity") >= least)


def most_similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, other): the most similar name on the right of each name on the left that has one, ties to the last in order.

    Sets of trigrams don't tell 000100 from 001000. So names have to be alike by letters too: the share of the letters that
    edits leave, words in order, has to reach the threshold as well, and the lesser of both measures counts.
    """
    sorted_words = lambda c: F.array_join(F.array_sort(name_words(F.col(c))), " ")
    pairs = similar_names(left, right, least).withColumns({"a": sorted_words("name"), "b": sorted_words("other")})
    left_over = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    alike = pairs.withColumn("alike", F.least("similarity", left_over)).where(F.col("alike") >= least)
    return alike.groupBy("name").agg(F.max(F.struct("alike", "other"))["other"].alias("other"))


def gazetteer(docs: DataFrame, names: list[str]) -> DataFrame:
    """(id, name, hits) of names that stand as whole words in a text; one alternation, so each text is read once."""
    import re

    by_folded = {n.lower(): n for n in names}
    pattern = r"(?<![\p{L}\p{N}_])(" + "|".join(re.escape(n) for n in sorted(by_folded, key=lambda n: (-len(n), n))) + r")(?![\p{L}\p{N}_])"
    found = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1))).alias("key"))
    known = F.create_map(*[F.lit(x) for kv in by_folded.items() for x in kv])
    return found.groupBy("id", F.element_at(known, F.col("key")).alias("name")).agg(F.count("*").alias("hits"))


def quality_score(captions: Column, has_author: Column, noise_share: Column, short: Column, bait: Column) -> Column:
    """0 to 100: less up to 15 for captions, 10 without an author, up to 20 for noise, 10 if short, 5 for a baiting title."""
    lost = (
        F.least(captions, F.lit(15))
        + F.when(has_author, 0).otherwise(10)
        + F.least(F.lit(20), F.bround(noise_share * 50).cast("int"))
        + F.when(short, 10).otherwise(0)
        + F.when(bait, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), 100 - lost)
