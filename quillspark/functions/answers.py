"""Checks of what models and services answer, as column expressions: tones, periods, rewrites, places."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .dates import anchor_year, relation_bounds
from .names import name_ratio
from .text import fold, strip, unaccent

#: Closed lists of labels, words of a prompt that must not come back, bounds of a rewrite, classes of places and their least likeness.
EMOTIONS = ("neutralny", "radosny", "smutny", "gniewny", "alarmistyczny", "podniosły", "refleksyjny")
SENTIMENTS = ("pozytywne", "negatywne", "neutralne", "mieszane")
INTENSITIES = ("niska", "średnia", "wysoka")
REGISTERS = ("formalny", "potoczny", "dziecinny", "wulgarny", "obraźliwy", "ironiczny")
MOST_LABELS = 2
LEAKS = ("wykonaj dwie rzeczy", "fragment do przepisania", "koniec fragmentu", "[kontekst")
SHORTEST, LONGEST, FEW_WORDS, LIKE_FEW, LIKE_MANY = 0.80, 1.15, 50, 0.75, 0.90
PLACE_CLASSES = ("natural", "water", "waterway", "place", "boundary", "landuse")
LEAST_LIKE = 0.75


def label(c: Column, labels: tuple[str, ...]) -> Column:
    """The label of a closed list that a word means, whatever its case and marks; null for others."""
    return F.coalesce(*[F.when(F.trim(F.lower(unaccent(c))) == F.lower(unaccent(F.lit(x))), F.lit(x)) for x in labels])


def labels(c: Column, known: tuple[str, ...], without: Column | None = None) -> Column:
    """The first labels of a list, each once, joined by commas; null where there are none."""
    found = F.array_distinct(F.filter(F.transform(c, lambda x: label(x, known)), lambda x: x.isNotNull()))
    if without is not None:
        found = F.filter(found, lambda x: x != without)
    return F.nullif(F.array_join(F.slice(found, 1, MOST_LABELS), ", "), F.lit(""))


def tone(answer: Column) -> Column:
    """A tone (emotion, secondary_emotions, sentiment, intensity, registers, evidence) from a JSON answer, fenced or not; null unless emotion, sentiment and intensity are known labels."""
    bare = strip(F.regexp_replace(strip(answer), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    a = F.from_json(bare, "emocja string, emocje_dodatkowe array<string>, nacechowanie string, intensywnosc string, rejestry array<string>, uzasadnienie string")
    emotion, sentiment, intensity = label(a["emocja"], EMOTIONS), label(a["nacechowanie"], SENTIMENTS), label(a["intensywnosc"], INTENSITIES)
    told = F.struct(
        emotion.alias("emotion"),
        labels(a["emocje_dodatkowe"], EMOTIONS, emotion).alias("secondary_emotions"),
        sentiment.alias("sentiment"),
        intensity.alias("intensity"),
        labels(a["rejestry"], REGISTERS).alias("registers"),
        F.nullif(strip(a["uzasadnienie"]), F.lit("")).alias("evidence"),
    )
    return F.when(emotion.isNotNull() & sentiment.isNotNull() & intensity.isNotNull(), told)


def subject_period(start: Column, end: Column, relation: Column, anchor: Column) -> Column:
    """(start, end, known): bounds that are given stay; else those that a relation to a known event gives. known is false where the event isn't known."""
    open_ = start.isNull() & end.isNull()
    usable = open_ & relation.isin("exact", "before", "after", "around")
    found = relation_bounds(relation, anchor_year(anchor), F.lit(None).cast("int"))
    known = F.when(usable & (F.coalesce(anchor, F.lit("")) != ""), anchor_year(anchor).isNotNull())
    return F.struct(F.when(usable, found["start"]).otherwise(start).alias("start"), F.when(usable, found["end"]).otherwise(end).alias("end"), known.alias("known"))


@F.pandas_udf(DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence ratio of the words of two texts in lower case."""
    words = lambda x: re.findall(r"\w+", x.lower())
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, words(x), words(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def rewrite_is_safe(kind: Column, topic: Column, summary: Column, rewritten: Column, source: Column) -> Column:
    """Whether a rewrite may stand: a known kind, all fields there, no words of the prompt, not shorter than four fifths of its source."""
    text = strip(rewritten)
    leaks = F.exists(F.array(*map(F.lit, LEAKS)), lambda m: F.contains(F.lower(text), m))
    long_enough = F.length(text) >= SHORTEST * F.greatest(F.length(source), F.lit(1))
    whole = kind.isin("TEMAT", "REKLAMA") & topic.isNotNull() & summary.isNotNull() & (text != "")
    return F.coalesce(whole & ~leaks & long_enough, F.lit(False))


def rewrite_is_doubtful(rewritten: Column, source: Column) -> Column:
    """Whether a rewrite that may stand asks for a look: over 15 % longer, or too few of its words in order those of the source."""
    ratio = F.length(strip(rewritten)) / F.greatest(F.length(source), F.lit(1))
    few = F.regexp_count(F.lower(source), F.lit(r"[\p{L}\p{N}_]+")) < FEW_WORDS
    return (ratio > LONGEST) | (word_ratio(source, strip(rewritten)) < F.when(few, LIKE_FEW).otherwise(LIKE_MANY))


def plausible_place(query: Column, kind: Column, display: Column) -> Column:
    """Whether a geocoder's hit is a place of that name: of a class of places, and a part of its display name like the query."""
    alike = name_ratio(fold(query), fold(display))
    return F.coalesce(kind.isin(*PLACE_CLASSES) & (F.coalesce(display, F.lit("")) != "") & (alike >= LEAST_LIKE), F.lit(False))
