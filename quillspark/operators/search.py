"""Lexical and vector search over one filter model, and their weighted merge."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, fold

#: Weights of the text score and of the merge, occurrences that fill a token's credit, least token length.
COVERAGE, TITLE_COVERAGE, PHRASE_BODY, PHRASE_TITLE = 0.70, 0.35, 0.20, 0.35
SEMANTIC_SHARE, TEXT_SHARE = 0.65, 0.35
SATURATION = 2
LEAST_TOKEN = 3


def query_tokens(query: str) -> list[str]:
    return sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) >= LEAST_TOKEN})


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_hits(embeddings: DataFrame, vector: list[float], least: float, docs: DataFrame | None = None) -> DataFrame:
    """(document_id, similarity) of the best fragment of each document above `least`, after the documents' filters."""
    norm = sum(x * x for x in vector) ** 0.5 or 1.0
    target = F.array(*[F.lit(float(x) / norm) for x in vector])
    dot = F.aggregate(F.zip_with("embedding", target, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    own = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = embeddings if docs is None else embeddings.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    scored = rows.select("document_id", F.try_divide(dot, own).alias("similarity")).where(F.col("similarity") > least)
    return scored.groupBy("document_id").agg(F.max("similarity").alias("similarity"))


def folded_pattern(text: str) -> str:
    """A pattern for what a folded text is in unfolded ones: each letter in either case, with or without marks. Texts needn't be folded to be searched."""
    forms: dict[str, str] = {"k": "\u212a"}
    for marked, plain in zip(MARKED, PLAIN, strict=True):
        forms[plain.lower()] = forms.get(plain.lower(), "") + marked + marked.lower() + marked.upper()
    one = lambda c: f"[{c}{c.upper() if len(c.upper()) == 1 else ''}{''.join(x for x in forms.get(c, '') if x.isalpha())}]" if c.isalpha() else re.escape(c)
    return "".join(map(one, text))


def token_coverage(body: Column, tokens: list[str]) -> Column:
    """The mean over folded tokens of min(1, occurrences / 2), in any case and with any marks."""
    if not tokens:
        return F.lit(0.0)
    one = lambda w: F.least(F.lit(1.0), F.regexp_count(body, F.lit(folded_pattern(w))) / F.lit(float(SATURATION)))
    total = one(tokens[0])
    for w in tokens[1:]:
        total = total + one(w)
    return total / len(tokens)


def lexical_hits(docs: DataFrame, query: str) -> DataFrame:
    """(document_id, text_score) of documents whose title or body holds the phrase, or whose body holds every token; marks and case don't matter.

    Bodies are searched as they are, by patterns of every form of a letter: no text is folded, and a text is counted only if it is a hit.
    """
    phrase, tokens = fold_literal(query), [fold_literal(w) for w in query_tokens(query)]
    rows = docs.select("id", fold(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    in_title, in_body = F.contains("title", F.lit(phrase)), F.col("body").rlike(folded_pattern(phrase))
    every = F.lit(bool(tokens))
    for w in tokens:
        every = every & F.col("body").rlike(folded_pattern(w))
    score = COVERAGE * token_coverage(F.col("body"), tokens) + TITLE_COVERAGE * token_coverage(F.col("title"), tokens) + PHRASE_BODY * in_body.cast("double") + PHRASE_TITLE * in_title.cast("double")
    return rows.where(in_title | in_body | every).select(F.col("id").alias("document_id"), F.least(F.lit(1.0), score).alias("text_score"))


def fold_literal(text: str) -> str:
    return " ".join(text.translate(str.maketrans(MARKED, PLAIN)).lower().split())


def merge_hits(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both legs by document: similarity is the best of text, vector and their weighted sum; match tells which legs met."""
    both = lexical.join(semantic.withColumnRenamed("similarity", "semantic"), "document_id", "full")
    text, vector = F.coalesce("text_score", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    match = F.when(F.col("text_score").isNotNull() & F.col("semantic").isNotNull(), "hybrid").when(F.col("semantic").isNotNull(), "semantic").otherwise("text")
    return both.select("document_id", F.round(F.greatest(text, vector, SEMANTIC_SHARE * vector + TEXT_SHARE * text), 6).alias("similarity"), match.alias("match"))


def hybrid(docs: DataFrame, embeddings: DataFrame, query: str, vector: list[float] | None, least: float, limit: int) -> DataFrame:
    """The best documents of both legs; without a vector the lexical leg alone."""
    lexical = lexical_hits(docs, query)
    semantic = vector_hits(embeddings, vector, least, docs) if vector else lexical.select("document_id", F.lit(None).cast("double").alias("similarity")).where(F.lit(False))
    return merge_hits(lexical, semantic).orderBy(F.desc("similarity"), F.asc("document_id")).limit(limit)


def neighbours_of(rows: DataFrame, queries: DataFrame, k: int = 10, row_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(id, neighbour, rank, similarity): the k nearest rows of every query by cosine, itself left out; both are (id, embedding).

    Exact, in blocks: rows and queries are dealt into blocks of bounded size, and each pair of blocks is one matrix product that
    gives at most k rows a query. These partial lists are merged by a window that keeps k a query. Similarity is
    rounded to six places, ties go to the smaller id. A vector of length zero has no neighbours.
    """

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        return df.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)), n

    r, row_blocks = blocks(rows, row_block, "r")
    q, query_blocks = blocks(queries, query_block, "q")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left, right = r.select("r", every(query_blocks, "q"), "id", "embedding"), q.select(every(row_blocks, "r"), "q", "id", "embedding")

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = t.column("id").to_numpy()
            m = np.array(t.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
            norm = np.sqrt((m * m).sum(axis=1))
            return ids[norm > 0], m[norm > 0] / norm[norm > 0, None]

        (ids, m), (asked, v) = unit(ours), unit(theirs)
        if not len(ids) or not len(asked):
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        by_id = np.argsort(ids, kind="stable")
        ids, m = ids[by_id], m[by_id]
        scores = np.round(v @ m.T, 6)
        scores[asked[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, top, axis=1)
        keep = np.isfinite(found)
        return pa.table({"id": np.repeat(asked, top.shape[1]).reshape(top.shape)[keep], "neighbour": ids[top][keep], "similarity": found[keep]})

    partial = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(best, "id long, neighbour long, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return partial.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
