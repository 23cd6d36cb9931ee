"""Secret scans: known patterns, and tokens whose format is likely under automata learned from labelled credentials."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps_names, with_columns
from .secret_grammar import Automaton, infer

#: The kinds of the base scan in order, their patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
LEARNED = "format"
PLAIN = re.compile(r"[A-Za-z]{8,40}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind in KINDS:
        pattern, group, least = PATTERNS[kind]
        if kind == "hex":  # greedy runs, so that only long runs can pass
            found += [(kind, *m.span()) for m in LONG_HEX.finditer(text)]
        else:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def learned_spans(text: str, formats: dict[str, Automaton], plain: Automaton, margin: float) -> list[tuple[str, int, int]]:
    """Candidates whose likelihood under some format exceeds that under plain words by the margin."""
    if not formats:
        return []
    likely = lambda m: max(f.log_likelihood(m) for f in formats.values()) - plain.log_likelihood(m) > margin
    return [(LEARNED, *m.span()) for m in CANDIDATE.finditer(text) if likely(m[0])]


def labelled_credentials(docs: DataFrame, text_col: str, sample_values: int, sample_words: int, max_chars: int) -> tuple[dict[str, list[str]], list[str]]:
    """Values of the base scan by kind, at most sample_values of each, and at most sample_words long plain words, from all documents with a credential.

    Values and words are read from whole texts in one pass; those of the least hashes are taken, so the sample is the same on
    every run and depends on no order. Each task hands on only the least of its batches, and values of over max_chars
    characters are left out, so what comes to the driver is bounded.
    """
    likely = F.col(text_col).rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    most = {k: sample_values for k in KINDS} | {"plain": sample_words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, set[tuple[int, str]]] = {k: set() for k in most}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, (pattern, group, size) in PATTERNS.items():
                    least[kind] |= {(xxhash.xxh64_intdigest(m[group]) >> 1, m[group]) for m in pattern.finditer(text) if size <= len(m[group]) <= max_chars}
                least["plain"] |= {(xxhash.xxh64_intdigest(w) >> 1, w) for w in PLAIN.findall(text)}
                for kind, found in least.items():
                    if len(found) > 4 * most[kind]:
                        least[kind] = set(nsmallest(most[kind], found))
        rows = [(k, h, v) for k, found in least.items() for h, v in nsmallest(most[k], found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "h", "value"])

    rows = docs.where(likely).select(text_col).mapInArrow(run, "kind string, h long, value string").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("kind") == "plain", sample_words).otherwise(sample_values))
    by_kind: dict[str, list[str]] = defaultdict(list)
    for kind, value in sorted((r["kind"], r["value"]) for r in chosen.select("kind", "value").collect()):
        by_kind[kind].append(value)
    return by_kind, by_kind.pop("plain", [])


@keeps_names
def scan_secrets(docs: DataFrame, sample_values: int = 400, sample_words: int = 2000, max_chars: int = 200, margin: float = 0.7, text_col: str = "text") -> DataFrame:
    """Finds secrets in whole texts.

    Base kinds: assignments, access keys and hex runs, leftmost and non-overlapping per kind. Beside them, every run of 16 or more
    token characters is scored by automata that ALERGIA-style state merging learns from labelled credentials: base matches, at most
    sample_values of each kind, of at most max_chars characters (the bounds of the sample, which is drawn by hash over all
    rows); at most sample_words long words of the same documents give the automaton of plain text. A run is a `format` span if
    its mean log likelihood a character is higher by `margin` under a format, also where it lies in a base span. Scanning
    covers all rows and whole texts; only the fitting is on the sample. A kind with fewer than 5 values has no automaton.

    Adds spans (kind, start, end: code points, end exclusive, by start, then kind) over an input column of that name.
    All rows stay. Null text has no spans; repeated rows and ties are scanned one by one; an empty table, or one without
    credentials, has base spans only.
    """
    by_kind, words = labelled_credentials(docs, text_col, sample_values, sample_words, max_chars)
    formats = {k: infer(v) for k, v in by_kind.items() if len(v) >= 5}
    plain = infer(words)
    order = {k: i for i, k in enumerate((*KINDS, LEARNED))}

    @F.pandas_udf(SPAN)
    def spans(texts):
        import pandas as pd

        def of(text):
            base = base_spans(text or "")
            found = base + learned_spans(text or "", formats, plain, margin)
            return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda s: (s[1], order[s[0]]))]

        return pd.Series([of(t) for t in texts])

    return with_columns(docs, [], spans=spans(F.col(text_col)))
