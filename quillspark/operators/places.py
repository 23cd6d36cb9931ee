"""Place names in any inflected form: one name for a mention, the names inside texts, a country glued to a mention."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions.chunking import let
from ..functions.text import MARKED, PLAIN, strip, unaccent

#: Letters that a mention may add to each stem; words that a glued country may have.
ENDING, EDGE = 4, 4
FORM = "struct<name:string,words:array<struct<stem:string,open:boolean>>,fixed:int,open:int>"


def plain(c: Column) -> Column:
    return strip(F.lower(unaccent(c)))


def plain_name(name: str) -> str:
    """A name of a table as `plain` has a mention, its words parted by single spaces."""
    return " ".join(name.translate(str.maketrans(MARKED, PLAIN)).lower().replace("-", " ").split())


def _forms(table: dict[str, tuple[str, ...]]) -> tuple[int, list[dict]]:
    """How many letters every first word has at least, and the forms as rows."""
    rows = []
    for name, forms in table.items():
        for form in forms:
            words = [{"stem": w.rstrip("*"), "open": w.endswith("*")} for w in form.split()]
            rows.append({"name": name, "words": words, "fixed": sum(len(w["stem"]) for w in words), "open": sum(w["open"] for w in words)})
    return min(len(r["words"][0]["stem"]) for r in rows), rows


def _fits(words: Column, form: Column) -> Column:
    """Whether the first words are those of the form."""
    same = F.zip_with(F.slice(words, 1, F.size(form)), form, lambda w, f: F.when(f["open"], F.startswith(w, f["stem"])).otherwise(w == f["stem"]))
    return F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def canonical_name(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The name that a whole mention is, else the one that it is a form of; null where none or several fit. Forms are looked up by their first letters, within the row."""
    head, rows = _forms(table)
    by_head: dict[str, list[dict]] = {}
    for r in rows:
        by_head.setdefault(r["words"][0]["stem"][:head], []).append(r)
    known = F.from_json(F.lit(json.dumps(by_head)), f"map<string,array<{FORM}>>")

    def of(words: Column) -> Column:
        near = F.coalesce(F.try_element_at(known, F.left(F.get(words, 0), F.lit(head))), F.array().cast(f"array<{FORM}>"))
        letters = F.length(F.array_join(words, ""))
        whole = lambda f: (F.size(f["words"]) == F.size(words)) & (letters - f["fixed"] <= ENDING * f["open"]) & _fits(words, f["words"])
        names = F.array_distinct(F.transform(F.filter(near, whole), lambda f: f["name"]))
        return F.when(F.size(names) == 1, F.get(names, 0))

    names = F.create_map(*[F.lit(x) for name in table for x in (plain_name(name), name)])
    own = F.try_element_at(names, F.regexp_replace(plain(c), r"[\s-]+", " "))
    return F.coalesce(own, F.when(plain(c).rlike(r"^\w+([\s-]+\w+)*$"), let(F.split(plain(c), r"[\s-]+"), of)))


def country_of(surface: Column) -> Column:
    """The country of an abbreviation in capitals, else of an inhabitant, else of a form of its name."""
    said = F.trim(F.regexp_replace(surface, r"\s+", " "))
    pick = lambda table, key: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])
    return F.coalesce(F.when(said == F.upper(said), pick(P.COUNTRY_CODES, said)), pick(P.INHABITANTS, F.lower(said)), canonical_name(said, P.COUNTRIES))


def split_country(c: Column) -> Column:
    """(rest, country) of a mention that ends, else begins, with a country of up to four words, the longest first; null where none does or nothing is left."""
    tidy = lambda words: F.btrim(F.array_join(words, " "), F.lit(" ,-"))

    def of(words: Column) -> Column:
        n = F.size(words)
        cut = lambda first, rest: F.struct(tidy(rest).alias("rest"), F.array_join(first, " ").alias("said"))
        takes = F.when(n > 1, F.sequence(F.least(F.lit(EDGE), n - 1), F.lit(1))).otherwise(F.array().cast("array<int>"))
        ends = F.transform(takes, lambda k: cut(F.slice(words, n - k + 1, k), F.slice(words, 1, n - k)))
        starts = F.transform(takes, lambda k: cut(F.slice(words, 1, k), F.slice(words, k + 1, n - k)))
        told = F.transform(F.concat(ends, starts), lambda x: F.struct(x["rest"].alias("rest"), canonical_name(x["said"], P.COUNTRIES).alias("country")))
        return F.get(F.filter(told, lambda x: x["country"].isNotNull() & (x["rest"] != "")), 0)

    return let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), of)


#: Letters of a word in a text in lower case: those that are plain, and those that `plain` makes so.
_FORMS_OF = {p: "".join(m for m, q in zip(MARKED, PLAIN, strict=True) if q == p and m.islower()) for p in set(PLAIN.lower())}
WORD = rf"[\w{''.join(sorted(_FORMS_OF.values()))}]"


def first_words(rows: list[dict]) -> str:
    """A pattern of what a text (in lower case) has where the first word of any form stands: letters in a tree, each in every form that is made plain."""
    tree: dict = {}
    for r in rows:
        at = tree
        for letter in r["words"][0]["stem"]:
            at = at.setdefault(letter, {})
        at["open" if r["words"][0]["open"] else "whole"] = {}

    def said(at: dict) -> str:
        if "open" in at:
            return ""
        ways = [f"[{letter}{_FORMS_OF.get(letter, '')}]{said(below)}" for letter, below in sorted(at.items()) if letter != "whole"]
        ways += [rf"(?!{WORD})"] if "whole" in at else []
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return said(tree)


def names_in(docs: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, name) of the names that any form of stands in a text (id, text), each once.

    One pattern over a text finds the runs of words whose first word is that of a form, overlapping ones too. Only these leave the text as rows and
    meet the forms, a fixed list that is broadcast, in a hash join on their first letters.
    """
    head, rows = _forms(table)
    longest = max(len(r["words"]) for r in rows)
    forms = docs.sparkSession.createDataFrame([(json.dumps(r),) for r in rows], "form string").select(F.from_json("form", FORM).alias("form"))
    forms = forms.select("form", F.left(F.get("form.words", F.lit(0))["stem"], F.lit(head)).alias("head"))
    # the run stands in a lookahead, so that the next one may begin inside it
    run = rf"(?<!{WORD})(?={first_words(rows)})(?=({WORD}+(?:[\s-]+{WORD}+){{0,{longest - 1}}}))"
    runs = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(run), F.lit(1)))).alias("run"))
    said = runs.select("id", F.split(unaccent(F.col("run")), r"[\s-]+").alias("words"))
    met = said.join(F.broadcast(forms), F.left(F.get("words", F.lit(0)), F.lit(head)) == F.col("head"))
    return met.where(_fits(F.col("words"), F.col("form.words"))).select("id", F.col("form.name").alias("name")).distinct()


def rejected(surface: Column, lemma: Column, pos: Column) -> Column:
    """Whether a tagger's surface and lemma are a pair known as no name for that part of speech; never without one."""
    same = lambda c, v: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) == v
    rules = [same(surface, s) & same(lemma, m) & F.upper(F.trim(pos)).isin(*kinds) for s, m, kinds in P.REJECTED_PAIRS]
    return F.coalesce(F.array_contains(F.array(*rules), True), F.lit(False))


def merged_places(mentions: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """Mentions (document_id, name, variants, mentions) under their canonical names, those that become alike in one row: all variants, the sum of mentions."""
    named = mentions.withColumn("name", F.coalesce(canonical_name(F.col("name"), table), F.col("name")))
    return named.groupBy("document_id", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.sum("mentions").alias("mentions"))


def cached(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (query) answered from a cache (query, place), and the distinct queries that it lacks, which are the work left."""
    wanted = asked.select("query").distinct()
    return asked.join(cache, "query"), wanted.join(cache.select("query"), "query", "left_anti")


def orphan_tags(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, tag) of place and country tags (tags: comma separated) whose slug no entity (document_id, slug) of the document has."""
    tags = docs.select("document_id", F.explode(F.array_distinct(F.transform(F.split("tags", ","), lambda x: F.trim(x)))).alias("tag")).where(F.col("tag").rlike("^(miejsce|kraj)-"))
    slugged = tags.withColumn("slug", F.regexp_replace("tag", "^[a-z]+-", ""))
    return slugged.join(entities.select("document_id", "slug"), ["document_id", "slug"], "left_anti").select("document_id", "tag")
