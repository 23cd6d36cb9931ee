"""Name guards and spellings; Python helpers stay small and run over Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .text import unaccent

#: Quotation marks that open, close, or do both.
OPENING, CLOSING, BOTH = "„“«", "”»", '"'


def balanced(text: str | None) -> str | None:
    """A name without wrapping or unpaired quotation marks; paired inner ones and apostrophes stay."""
    if text is None:
        return None
    while True:
        waiting: list[int] = []
        paired: dict[int, int] = {}
        for at, c in enumerate(text):
            closes = waiting and (c in CLOSING or c in BOTH or c == "“") and (c != BOTH or text[waiting[-1]] in OPENING + BOTH)
            if closes:
                paired[waiting.pop()] = at
            elif c in OPENING + BOTH + CLOSING:
                waiting.append(at)
        paired = {a: b for a, b in paired.items() if b > a + 1}
        ends = set(paired) | set(paired.values())
        kept = "".join(c for at, c in enumerate(text) if at in ends or c not in OPENING + BOTH + CLOSING).strip()
        if kept == text and paired.get(0) == len(text) - 1 and len(text) > 1:
            kept = text[1:-1].strip()
        if kept == text:
            return text
        text = kept


@F.pandas_udf(StringType())
def clean_quotes(names: pd.Series) -> pd.Series:
    return names.map(balanced)


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best sequence ratio of a name and the comma parts of another, in lower case."""
    best = lambda x, y: max((difflib.SequenceMatcher(None, x.lower().strip(), p.strip().lower()).ratio() for p in y.split(",")), default=0.0)
    return pd.Series([None if x is None or y is None else best(x, y) for x, y in zip(a, b, strict=True)])


def label_matches(mention: Column, label: Column) -> Column:
    """Whether a token of the mention (3 or more letters) opens one of the label (2 or more), or the other way round, or stands in the joined label."""
    ours = F.filter(F.split(F.lower(unaccent(mention)), r"\s+"), lambda x: F.length(x) >= 3)
    theirs = F.filter(F.split(F.lower(unaccent(label)), r"[\s-]+"), lambda x: F.length(x) >= 2)
    return F.exists(ours, lambda m: F.exists(theirs, lambda x: F.startswith(x, m) | F.startswith(m, x)) | F.contains(F.array_join(theirs, ""), m))


def is_truncated_lemma(base: Column, variants: Column) -> Column:
    """Whether every variant is the base with two or more letters behind it."""
    return (F.size(variants) > 0) & F.forall(variants, lambda v: F.startswith(F.lower(v), F.lower(base)) & (F.length(v) - F.length(base) >= 2))


def is_initials(surface: Column) -> Column:
    return surface.rlike(r"^\s*(\p{Lu}\.\s*(\s+|\z))+\z")


def preferred_spelling(spellings: Column) -> Column:
    """Of spellings in order of appearance: the most frequent capitalised one, else the most frequent, the first of equals."""
    kinds = F.array_distinct(F.filter(spellings, lambda s: s != ""))
    scored = F.transform(kinds, lambda s: F.struct(s.rlike(r"^\p{Lu}").alias("capital"), F.size(F.filter(spellings, lambda x: x == s)).alias("n"), (-F.array_position(spellings, s)).alias("first"), s.alias("s")))
    return F.array_max(scored)["s"]
