"""Organisations that a text names as its sources, by the words around their mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Phrases that attribute what follows, verbs that attribute to what comes before, the forms that attribute to
#: what comes after them, and sources with a name, kind and domain of their own.
BEFORE = ("według", "zdaniem", "za", "jak podaje", "jak informuje", "jak donosi", "podają", "informują", "donoszą", "powołując się na", "na podstawie", "dane od", "dane z")
AFTER = ("podaje", "podają", "informuje", "informują", "donosi", "donoszą", "poinformował", "poinformowała", "poinformowało", "ustalił", "ustaliła", "ustaliło", "ujawnił", "ujawniła", "ujawniło")
ONWARD = ("podaje", "podają")
KNOWN = {"bloomberg": ("Bloomberg", "agency", "bloomberg.com"), "kcna": ("KCNA", "agency", "kcna.kp")}
#: How far before a mention a phrase may stand.
REACH = 100


def _any(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + ")"


def sentences(text: Column) -> Column:
    """Sentences and lines, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def attributes(sentence: Column, start: Column, end: Column) -> Column:
    """Whether a sentence makes the mention at [start, end) (from 0) its source.

    It does if the clause before the mention holds a phrase that attributes, or if a verb follows that does and nothing later attributes to something else.
    """
    clause = F.regexp_extract(F.left(sentence, start), r"([^,;:]*)$", 1)
    rest = F.substring(sentence, end + 1, F.length(sentence))
    before = clause.rlike(rf"(?isU)(?<!\w){_any(BEFORE)}(?!\w).{{0,{REACH}}}$")
    after = rest.rlike(rf"(?iU)^\s*,?\s*{_any(AFTER)}(?!\w)") & ~rest.rlike(rf"(?iU){_any(ONWARD)}\s")
    return before | after


def cited_sources(docs: DataFrame, organizations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, mention, source_type, domain, evidence): the organisations of each document that it cites.

    docs: key, text. organizations: key, name, variants. Sentences and names meet by document; a sentence that doesn't hold the name drops out
    before any pattern is tried. Of a sentence's variants the name itself comes first, then the others in order, and the first place of
    the first one found counts. A name's first sentence that attributes is the evidence; names of one known source are one.
    """
    said = docs.select(F.col(key).alias("k"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    names = organizations.where(strip(F.col("name")) != "").select(F.col(key).alias("k"), strip(F.col("name")).alias("name"), F.posexplode(F.concat(F.array(strip(F.col("name"))), F.coalesce("variants", F.array().cast("array<string>")))).alias("turn", "variant"))
    met = said.join(names.where(F.trim("variant") != ""), "k").where(F.contains(F.lower("sentence"), F.lower("variant")))
    whole = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), "variant", F.lit(r"\E(?!\w)"))
    at = F.regexp_instr("sentence", whole)
    found = met.withColumn("at", at).where("at > 0")
    first = found.groupBy("k", "name", "pos").agg(F.min(F.struct("turn", "at", "variant", "sentence")).alias("m"))
    start = F.col("m.at") - 1
    mention = F.substring(F.col("m.sentence"), F.col("m.at"), F.length("m.variant"))
    cited = first.where(attributes(F.col("m.sentence"), start, start + F.length("m.variant"))).select("k", "name", "pos", "m.at", mention.alias("mention"), F.left(F.col("m.sentence"), F.lit(1000)).alias("evidence"))
    told = F.create_map(*[F.lit(x) for name, known in KNOWN.items() for x in (name, known[0])])
    kinds = {i: F.create_map(*[F.lit(x) for known in KNOWN.values() for x in (known[0], known[i])]) for i in (1, 2)}
    named = cited.withColumn("source", F.coalesce(F.try_element_at(told, F.lower("name")), "name"))
    best = named.groupBy("k", F.lower("source").alias("same")).agg(F.min(F.struct("pos", "at", "source", "mention", "evidence")).alias("b"))
    return best.select(F.col("k").alias(key), "b.source", "b.mention", F.coalesce(F.try_element_at(kinds[1], F.col("b.source")), F.lit("organization")).alias("source_type"), F.try_element_at(kinds[2], F.col("b.source")).alias("domain"), "b.evidence")
