"""Hybrid search: the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN
from ..operators.filters import SearchFilters, apply_filters
from ..operators.search import hybrid, lexical_hits, neighbours_of, token_coverage, vector_hits
from .registry import query

QUERY = "and was the"
FOLD = f"lower(translate(%s, '{MARKED}', '{PLAIN}'))"


def documents(t):
    return t("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.concat(F.lit("Über "), F.col("source"), F.lit(" the")).alias("title"))


def vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")


def first_vector(t) -> list[float]:
    row = t("embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else []


_SEM = "SELECT e.vec_id AS document_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _lex(query: str, where: str = "") -> str:
    """SQL of the lexical leg for a query whose folded words are its tokens."""
    tokens, phrase = query.split(), query
    share = lambda c: "(" + " + ".join(f"least(1.0::DOUBLE, len(regexp_extract_all({c}, '{w}')) / 2.0::DOUBLE)" for w in tokens) + f") / {len(tokens)}"
    every = " AND ".join(f"contains(body, '{w}')" for w in tokens)
    return f"""
    SELECT doc_id AS document_id, least(1.0::DOUBLE, 0.70::DOUBLE * ({share("body")}) + 0.35::DOUBLE * ({share("title")}) + 0.20::DOUBLE * contains(body, '{phrase}')::INT + 0.35::DOUBLE * contains(title, '{phrase}')::INT) AS text_score
    FROM (SELECT doc_id, {FOLD % "coalesce(text, '')"} AS body, {FOLD % "'Über ' || source || ' the'"} AS title FROM documents {where}) WHERE contains(title, '{phrase}') OR contains(body, '{phrase}') OR ({every})"""


@query(f"SELECT document_id, round(sim, 6) AS similarity FROM ({_SEM}) s JOIN documents ON doc_id = document_id WHERE lang = 'en' AND sim > 0.3 ORDER BY similarity DESC, document_id LIMIT 10")
def vector_topk_filtered(t):
    docs = apply_filters(documents(t), SearchFilters(languages=("en",)))
    hits = vector_hits(vectors(t), first_vector(t), 0.3, docs).withColumn("similarity", F.round("similarity", 6))
    return hits.orderBy(F.desc("similarity"), F.asc("document_id")).limit(10)


@query(f"SELECT document_id, round(text_score, 6) AS text_score FROM ({_lex(QUERY)})")
def lexical_search(t):
    return lexical_hits(documents(t), QUERY).withColumn("text_score", F.round("text_score", 6))


#: A phrase of titles, marks and cases in queries and texts, words that no text has.
LEXICAL = {"Über SRC1": "uber src1", "élan pour": "elan pour", "más ein": "mas ein", "nowhere-to-be-found": "nowhere to be found"}


@query(" UNION ALL ".join(f"SELECT '{asked}' AS query, document_id, round(text_score, 6) AS text_score FROM ({_lex(folded)})" for asked, folded in list(LEXICAL.items())[:3]))
def lexical_phrases(t):
    found = [lexical_hits(documents(t), q).select(F.lit(q).alias("query"), "document_id", F.round("text_score", 6).alias("text_score")) for q in LEXICAL]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query(f"""
WITH lex AS ({_lex(QUERY, "WHERE lang = 'en'")}), sem AS (SELECT document_id, sim FROM ({_SEM}) s WHERE sim > 0.2 AND document_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
m AS (SELECT coalesce(lex.document_id, sem.document_id) AS document_id, coalesce(text_score, 0) AS t, coalesce(sim, 0) AS s, CASE WHEN text_score IS NOT NULL AND sim IS NOT NULL THEN 'hybrid' WHEN sim IS NOT NULL THEN 'semantic' ELSE 'text' END AS match FROM lex FULL JOIN sem ON lex.document_id = sem.document_id)
SELECT document_id, round(greatest(t, s, 0.65::DOUBLE * s + 0.35::DOUBLE * t), 6) AS similarity, match FROM m ORDER BY similarity DESC, document_id LIMIT 50
""")
def hybrid_search(t):
    docs = apply_filters(documents(t), SearchFilters(languages=("en",)))
    return hybrid(docs, vectors(t), QUERY, first_vector(t), 0.2, 50)


@query(f"SELECT doc_id, round((least(1.0::DOUBLE, len(regexp_extract_all(body, 'the')) / 2.0::DOUBLE) + least(1.0::DOUBLE, len(regexp_extract_all(body, 'idiot')) / 2.0::DOUBLE)) / 2, 6) AS coverage FROM (SELECT doc_id, {FOLD % 'text'} AS body FROM documents)")
def coverage(t):
    return t("documents").select("doc_id", F.round(token_coverage(F.col("text"), ["the", "idiot"]), 6).alias("coverage"))


@query("""
WITH c AS (SELECT 'lang' AS field, lang AS expected, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS actual FROM documents UNION ALL SELECT 'source', CASE WHEN doc_id % 5 > 0 THEN source END, CASE WHEN doc_id % 4 > 0 AND doc_id % 5 > 0 THEN upper(source) END FROM documents)
SELECT field, count(*) AS cases, count(*) FILTER (lower(expected) IS NOT DISTINCT FROM lower(actual)) AS hits, round(count(*) FILTER (lower(expected) IS NOT DISTINCT FROM lower(actual)) * 100.0::DOUBLE / count(*), 2) AS percent FROM c GROUP BY field
""")
def parser_eval(t):
    """Fields told for each document against those expected: some wrong, some missing, some rightly null, case aside."""
    d, k = t("documents"), F.col("doc_id")
    expected = d.select("doc_id", "lang", F.when(k % 5 > 0, F.col("source")).alias("source")).unpivot("doc_id", ["lang", "source"], "field", "expected")
    told = d.select("doc_id", F.when(k % 3 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when((k % 4 > 0) & (k % 5 > 0), F.upper("source")).alias("source")).unpivot("doc_id", ["lang", "source"], "field", "actual")
    right = F.lower("expected").eqNullSafe(F.lower("actual"))
    scored = expected.join(told.where("actual IS NOT NULL"), ["doc_id", "field"], "left").groupBy("field").agg(F.count("*").alias("cases"), F.count_if(right).alias("hits"))
    return scored.withColumn("percent", F.round(F.col("hits") * 100.0 / F.col("cases"), 2))


@query("""
WITH s AS (SELECT q.vec_id AS id, e.vec_id AS neighbour, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM s) SELECT id, neighbour, rank, similarity FROM r WHERE rank <= 10
""")
def vector_neighbours(t):
    """Every vector whose id is divisible by 20 is a query, against all vectors."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return neighbours_of(rows, rows.where("id % 20 = 0"))
