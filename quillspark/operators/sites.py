"""Cleaning rules by site, and facilities near places."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_first, cut_from_last

_PLANT, _NUCLEAR = ("elektrownia", "elektrownię", "elektrowni"), ("jądrowa", "jądrowej")
#: Kinds of facility with their labels and the forms of the words that stand before a place.
FACILITIES = [
    ("nuclear_power_plant", "Elektrownia jądrowa", (_PLANT, _NUCLEAR)),
    ("power_plant", "Elektrownia", (_PLANT,)),
    ("refinery", "Rafineria", (("rafineria", "rafinerii", "rafinerię"),)),
    ("airport", "Lotnisko", (("lotnisko", "lotnisku"),)),
    ("seaport", "Port", (("porcie",),)),
]


def noun_pattern(words: tuple[tuple[str, ...], ...]) -> str:
    """Any form of each word, one after the other, in any case, up to where the place begins."""
    return r"(?iu)\b" + "".join(rf"(?:{'|'.join(forms)})\s+" for forms in words)


@dataclass(frozen=True)
class SiteRules:
    """What goes from pages of one site: all before a pattern, all from the last match of one, literals, matches."""

    remove_before: list[str] = field(default_factory=list)
    remove_after: list[str] = field(default_factory=list)
    remove_string: list[str] = field(default_factory=list)
    remove_string_regexp: list[str] = field(default_factory=list)

    def apply(self, text: Column) -> Column:
        for p in self.remove_before:
            text = after_first(text, p)
        for p in self.remove_after:
            text = cut_from_last(text, p)
        for s in self.remove_string:
            text = F.replace(text, F.lit(s), F.lit(""))
        for p in self.remove_string_regexp:
            text = F.regexp_replace(text, p, "")
        return text


def site_rules(told: dict[str, dict[str, list[str]]]) -> dict[str, SiteRules]:
    """Rules of sites as a rules file has them: site, then kind of rule, then what goes. Kinds that aren't known are errors."""
    return {site: SiteRules(**rules) for site, rules in told.items()}


def clean_pages(pages: DataFrame, rules: dict[str, SiteRules], url: str = "url", text: str = "text") -> DataFrame:
    """Pages with the rules of each site whose key stands in their URL, then the `_global` ones, then at most one blank line in a row."""
    pages = pages.withColumn(text, F.replace(text, F.lit(" "), F.lit(" ")))
    for site, rule in rules.items():
        if site != "_global":
            pages = pages.withColumn(text, F.when(F.contains(url, F.lit(site)), rule.apply(F.col(text))).otherwise(F.col(text)))
    if "_global" in rules:
        pages = pages.withColumn(text, rules["_global"].apply(F.col(text)))
    squeezed = F.regexp_replace(F.regexp_replace(text, r"\n[^\S\n]+\n", "\n\n"), r"\n{2,}", "\n\n")
    return pages.withColumn(text, F.btrim(squeezed, F.lit("\n")))


def facilities(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, facility_type, name, mentions): facility nouns right before a place that the document is known to mention.

    docs: id, text; places: id, place, names (array). A nuclear plant takes in the plain mentions of the same plant.
    """
    named = places.select("id", "place", F.explode(F.array_distinct(F.concat(F.array("place"), "names"))).alias("name")).where("name <> ''")
    quoted = F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E(?![\\p{L}\\p{N}_-])"))
    counts = F.array(*[F.struct(F.lit(kind).alias("facility_type"), F.lit(label).alias("label"), F.regexp_count("text", F.concat(F.lit(noun_pattern(words)), quoted)).alias("n")) for kind, label, words in FACILITIES])
    found = docs.join(named, "id").select("id", "place", F.explode(counts).alias("c")).select("id", "place", "c.*").where("n > 0")
    per = found.groupBy("id", "place", "facility_type", "label").agg(F.sum("n").alias("mentions"))
    nuclear = per.where("facility_type = 'nuclear_power_plant'").select("id", "place", F.lit(True).alias("has"))
    kind = F.when(F.coalesce("has", F.lit(False)) & (F.col("facility_type") == "power_plant"), "nuclear_power_plant").otherwise(F.col("facility_type"))
    label = F.when(kind == "nuclear_power_plant", FACILITIES[0][1]).otherwise(F.col("label"))
    merged = per.join(nuclear, ["id", "place"], "left").select("id", "place", kind.alias("facility_type"), label.alias("label"), "mentions")
    return merged.groupBy("id", "place", "facility_type", "label").agg(F.sum("mentions").alias("mentions")).select("id", "facility_type", F.concat_ws(" ", "label", "place").alias("name"), "mentions")
