"""Cited publications, repaired entities, and footnote numbers of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import books, evidence, mutations, publications
from .registry import query

_CHUNKS = "SELECT page_id % 50 AS document_id, page_id AS chunk_id, page_id % 7 AS k, page_id % 20 AS d FROM pages"
_STORED = "SELECT 'p' || d AS id, CASE WHEN d % 2 = 0 THEN (70000 + d)::VARCHAR END AS pmid, CASE WHEN d % 3 = 0 THEN 'pmc' || d END AS pmcid, '10.1234/AB.' || d AS doi, 'https://doi.org/10.1234/ab.' || d AS canonical_url FROM range(0, 10) r(d)"
_FOUND = f"""
c AS ({_CHUNKS}), p AS ({_STORED}),
f AS (SELECT document_id, chunk_id, 'doi' AS kind, '10.1234/ab.' || d AS identifier, 'See DOI: 10.1234/Ab.' || d || '.' AS citation FROM c WHERE k <> 6
  UNION ALL SELECT document_id, chunk_id, 'pmid', (70000 + d)::VARCHAR, '2. https://pubmed.ncbi.nlm.nih.gov/' || (70000 + d) || '/, seen' FROM c WHERE k IN (1, 2)
  UNION ALL SELECT document_id, chunk_id, 'pmcid', 'PMC' || d, 'last (https://www.ncbi.nlm.nih.gov/pmc/articles/Pmc' || d || '/)' FROM c WHERE k = 3),
r AS (SELECT f.*, coalesce(id, kind || ':' || identifier) AS publication, id FROM f LEFT JOIN p ON (kind = 'doi' AND lower(doi) = identifier) OR (kind = 'pmid' AND pmid = identifier) OR (kind = 'pmcid' AND upper(pmcid) = identifier)),
fresh AS (SELECT document_id, publication, min({{'chunk': chunk_id, 'citation': citation}}) AS m FROM r GROUP BY ALL),
links AS (SELECT d AS document_id, 'p' || d % 10 AS publication, -d - 1 AS chunk_id, 'old' AS citation FROM range(0, 60) t(d) UNION ALL SELECT page_id % 50, 'x', page_id, 'old chunk' FROM pages WHERE page_id % 7 = 2)
"""


def _chunks(t):
    d, k = F.col("page_id") % 20, F.col("page_id") % 7
    lines = F.concat_ws("\n", F.when(k != 6, F.concat(F.lit(" See DOI: 10.1234/Ab."), d, F.lit("."))), F.when(k.isin(1, 2), F.concat(F.lit("2. https://pubmed.ncbi.nlm.nih.gov/"), d + 70000, F.lit("/, seen"))), F.when(k == 3, F.concat(F.lit("first https://pmc.ncbi.nlm.nih.gov/articles/PMC"), d, F.lit("\nlast (https://www.ncbi.nlm.nih.gov/pmc/articles/Pmc"), d, F.lit("/)\nno PMC1, https://x.y/PMC2"))))
    return t("pages").select((F.col("page_id") % 50).alias("document_id"), F.col("page_id").alias("chunk_id"), F.when(k != 6, lines).alias("text"))


def _refreshed(t, whole: bool):
    spark = t("region").sparkSession
    stored = spark.range(10).selectExpr("concat('p', id) AS id", "CASE WHEN id % 2 = 0 THEN 70000 + id END AS pmid", "CASE WHEN id % 3 = 0 THEN concat('pmc', id) END AS pmcid", "concat('10.1234/AB.', id) AS doi", "concat('https://doi.org/10.1234/ab.', id) AS canonical_url")
    old = spark.range(60).selectExpr("id AS document_id", "concat('p', id % 10) AS publication", "-id - 1 AS chunk_id", "'old' AS citation").unionByName(t("pages").where("page_id % 7 = 2").selectExpr("page_id % 50 AS document_id", "'x' AS publication", "page_id AS chunk_id", "'old chunk' AS citation"))
    chunks = _chunks(t)
    return publications.refresh_publications(stored, old, chunks if whole else chunks.where("chunk_id % 3 = 0"), whole)


@query(f"WITH {_FOUND} SELECT document_id, publication, m['chunk'] AS chunk_id, m['citation'] AS citation FROM fresh UNION ALL SELECT * FROM links WHERE document_id NOT IN (SELECT document_id FROM c)")
def publications_linked(t):
    """Chunks that cite by three kinds of identifier, some of publications known under another one or in other case; one in seven is empty."""
    return _refreshed(t, True)[1]


@query(f"""
WITH {_FOUND.replace(_CHUNKS, _CHUNKS + " WHERE page_id % 3 = 0")}
SELECT document_id, publication, m['chunk'] AS chunk_id, m['citation'] AS citation FROM fresh UNION ALL SELECT l.* FROM links l WHERE chunk_id NOT IN (SELECT chunk_id FROM c) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.document_id = l.document_id AND f.publication = l.publication)
""")
def publications_of_chunks(t):
    """Only a third of the chunks are read anew: links of the others stay, but move if one of these cites the same."""
    return _refreshed(t, False)[1]


@query(f"WITH {_FOUND} SELECT * FROM p UNION ALL SELECT DISTINCT publication, CASE kind WHEN 'pmid' THEN identifier END, CASE kind WHEN 'pmcid' THEN identifier END, CASE kind WHEN 'doi' THEN identifier END, CASE kind WHEN 'pmid' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || identifier || '/' WHEN 'pmcid' THEN 'https://pmc.ncbi.nlm.nih.gov/articles/' || identifier || '/' ELSE 'https://doi.org/' || identifier END FROM r WHERE id IS NULL")
def publications_known(t):
    return _refreshed(t, True)[0]


#: Old entities of each customer by its key modulo 8: (type, text, variants, n), and new ones, their variants with base forms.
_OLD = [("persName", "Jan {}", ["Jana {}"], 2), ("persName", "Anna", [], 1), ("placeName", "Oslo", ["OSLO  city"], 3), ("geogName", "Wisła", [], 1), ("orgName", "Jan {}", [], 1)]
_NEW = [("persName", "JAN {}", ["anna"], 2, (0, 1, 2, 3)), ("placeName", "Oslo", ["oslo city"], 4, (0, 1, 4, 5)), ("geogName", "Wisła", [], 1, (0, 2, 4, 6)), ("placeName", "rzeka Wisła", ["wisła"], 1, (0, 3, 6)), ("persName", "Anna Nowak", ["Anna"], 1, (2, 5))]
_NAMED = "SELECT *, lower(trim(text)) AS t FROM"


def _values(rows, extra):
    lists = lambda vs: "[" + ", ".join(f"'{v}'" for v in vs) + "]::VARCHAR[]"
    return ", ".join(f"('{r[0]}', '{r[1]}', {lists(r[2])}, {r[3]}{', ' + str(list(r[4])) if extra else ''})" for r in rows)


_REPAIR = f"""
o AS (SELECT c_custkey AS document_id, type, replace(text, '{{}}', c_custkey::VARCHAR) AS text, list_transform(list_prepend(text, variants), lambda x: regexp_replace(lower(replace(x, '{{}}', c_custkey::VARCHAR)), '\\s+', ' ', 'g')) AS terms, n FROM customer, (VALUES {_values(_OLD, False)}) v(type, text, variants, n)),
w AS (SELECT c_custkey AS document_id, type, replace(text, '{{}}', c_custkey::VARCHAR) AS text, list_transform(list_prepend(text, variants), lambda x: regexp_replace(lower(replace(x, '{{}}', c_custkey::VARCHAR)), '\\s+', ' ', 'g')) AS terms, n FROM customer JOIN (VALUES {_values(_NEW, True)}) v(type, text, variants, n, marks) ON list_contains(marks, c_custkey % 8)),
m AS (SELECT o.document_id, o.type, o.text, o.terms, o.n, CASE WHEN count(DISTINCT w.text) = 1 THEN min(w.text) END AS canonical, CASE WHEN count(DISTINCT w.text) = 1 THEN max(w.n) END AS new_n FROM o LEFT JOIN w ON o.document_id = w.document_id AND (o.type = 'persName') = (w.type = 'persName') AND list_has_any(o.terms, w.terms) GROUP BY ALL)
"""


def _entities(t, rows, marked: bool):
    kinds = t("region").sparkSession.createDataFrame([(*r[:4], list(r[4]) if marked else None) for r in rows], "type string, text string, variants array<string>, n long, marks array<int>")
    put = lambda c: F.replace(c, F.lit("{}"), F.col("document_id").cast("string"))
    every = t("customer").select(F.col("c_custkey").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("i"))
    numbered = kinds.withColumn("i", F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rows) for x in (r[0] + r[1], k)]), F.concat("type", "text")))
    out = every.join(F.broadcast(numbered), "i")
    out = out.where(F.array_contains("marks", (F.col("document_id") % 8).cast("int"))) if marked else out
    return out.select("document_id", "type", put(F.col("text")).alias("text"), F.transform("variants", put).alias("variants"), "n")


@query(f"""
WITH {_REPAIR}
SELECT document_id, text, canonical, CASE WHEN canonical IS NULL THEN 'removed' WHEN count(*) OVER (PARTITION BY document_id, canonical) > 1 THEN 'merged' WHEN canonical <> text THEN 'renamed' WHEN n <> new_n THEN 'count' ELSE 'same' END AS change FROM m
""")
def entities_repaired(t):
    """Five old entities a customer against new ones of eight shapes: renamed, merged, ambiguous, of another family, gone."""
    return publications.entity_repairs(_entities(t, _OLD, False), _entities(t, _NEW, True))


@query(f"""
WITH {_REPAIR},
l AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_orderkey % 3 AS person, CASE o_orderkey % 4 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'jana  ' || o_custkey WHEN 2 THEN 'Nobody' ELSE 'JAN ' || o_custkey END AS mention FROM orders),
k AS (SELECT l.*, row_number() OVER (PARTITION BY l.document_id, person ORDER BY l.id) AS nth, m.text, m.canonical FROM l LEFT JOIN m ON m.document_id = l.document_id AND m.type = 'persName' AND list_contains(m.terms, regexp_replace(lower(mention), '\\s+', ' ', 'g')))
SELECT id, document_id, person, CASE WHEN nth = 1 THEN coalesce(canonical, mention) ELSE mention END AS mention, CASE WHEN nth > 1 THEN 'deduplicated' WHEN canonical = mention THEN 'kept' WHEN canonical IS NOT NULL THEN 'updated' WHEN text IS NOT NULL THEN 'removed' ELSE 'kept' END AS action FROM k
""")
def person_links_repaired(t):
    """Orders as links of customers to three persons each."""
    key = F.col("o_custkey").cast("string")
    mention = F.element_at(F.array(F.lit("ANNA"), F.concat(F.lit("jana  "), key), F.lit("Nobody"), F.concat(F.lit("JAN "), key)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    links = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 3).alias("person"), mention.alias("mention"))
    return publications.repaired_links(links, publications.canonical_names(_entities(t, _OLD, False), _entities(t, _NEW, True)))


@query("""
SELECT doc_id AS book, '# Spis treści' || chr(10) || 'esej1' || chr(10) || '# Jeden' || chr(10) || CASE WHEN doc_id % 4 = 2 THEN 'SHA256 ' || coalesce(lang, 'xx') || '1 x86 i x2, dalej3' ELSE 'SHA256 ' || coalesce(lang, 'xx') || ' x86 i x, dalej' || CASE WHEN doc_id % 4 = 3 THEN '4' ELSE '3' END END || chr(10) || '# Dwa' || chr(10) || coalesce(lang, 'xx') || CASE WHEN doc_id % 4 = 1 THEN '' ELSE '1' END || ' 1 log4j ' || chr(10) AS text,
  CASE doc_id % 4 WHEN 0 THEN '2:2/2' WHEN 1 THEN '2:2/2,3:1/1' WHEN 2 THEN '2:4/3' ELSE '2:2/2' END AS report
FROM documents
""")
def footnotes_stripped(t):
    """Books of three chapters: footnotes that are all found, one chapter in which some are missing, numbers that belong to words, chapters without notes."""
    k = F.col("doc_id") % 4
    lang = F.coalesce("lang", F.lit("xx"))
    end = F.when(k == 3, "4").otherwise("3")
    text = F.concat(F.lit("# Spis treści\nesej1\n# Jeden\nSHA256 "), lang, F.lit("1 x86 i x2, dalej"), end, F.lit("\n# Dwa\n"), lang, F.lit("1 1 log4j \n"))
    docs = t("documents")
    n = F.when(k == 2, 4).otherwise(2)
    notes = docs.select(F.col("doc_id").alias("book"), F.lit(2).alias("position"), n.alias("n")).unionByName(docs.where(k == 1).select(F.col("doc_id").alias("book"), F.lit(3).alias("position"), F.lit(1).alias("n"))).unionByName(docs.select(F.col("doc_id").alias("book"), F.lit(9).alias("position"), F.lit(1).alias("n")))
    out = books.strip_footnote_markers(docs.select(F.col("doc_id").alias("book"), text.alias("text")), notes)
    told = F.array_join(F.transform("report", lambda r: F.concat(r["position"], F.lit(":"), r["expected"], F.lit("/"), r["stripped"])), ",")
    return out.select("book", "text", told.alias("report"))


@query("SELECT doc_id, unnest([2, 3, 5]) AS position, unnest(['Wstęp', 'A ' || doc_id, 'B']) AS title, unnest(['https://e.com/r0/', 'https://e.com/r1/', 'https://e.com/r2/']) AS url FROM documents")
def chapter_sources(t):
    text = F.concat(F.lit("start\n# Wstęp\n# A "), "doc_id", F.lit("\n# Bibliografia\n# B\n"))
    rows = t("documents").select("doc_id", F.explode(books.chapter_sources(text, "https://e.com", "Wstęp", ("(wstęp)", "Bibliografia"))).alias("c"))
    return rows.select("doc_id", "c.*")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, l_partkey AS p, l_suppkey AS s, CASE WHEN l_linenumber % 5 = 0 THEN l_tax::DECIMAL(12,4) END AS reported FROM lineitem),
e AS (SELECT *, round(p::DECIMAL(12,0) * 2.5::DECIMAL(12,6) * 0.000001::DECIMAL(7,6), 10) + round(s::DECIMAL(12,0) * 0.333333::DECIMAL(12,6) * 0.000001::DECIMAL(7,6), 10) AS estimate FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN reported IS NOT NULL THEN reported::DOUBLE WHEN k = 1 THEN estimate::DOUBLE END AS amount, CASE WHEN reported IS NOT NULL THEN 'EUR' WHEN k = 1 THEN 'USD' END AS currency, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN k = 1 THEN 'estimated' ELSE 'unknown' END AS status, CASE WHEN k = 4 THEN 0 ELSE 1 END AS n_ids FROM e
""")
def usage_reported(t):
    """Calls with a reported cost, an estimate, a mode without one, no currency, a negative count."""
    k = F.col("l_linenumber") % 5
    cost = U.call_cost(F.when(k == 0, F.col("l_tax").cast("decimal(12,4)")), F.lit("EUR"), F.when(k == 2, "subscription").otherwise("per_token"), F.lit("2.5").cast("decimal(12,6)"), F.lit("0.333333").cast("decimal(12,6)"), F.when(k == 3, "").otherwise("USD"), F.when(k == 4, -1).otherwise(F.col("l_partkey")), F.col("l_suppkey"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", U.usage_report(F.when(k != 4, F.col("l_orderkey")), F.col("l_partkey"), cost).alias("u"))
    return rows.select("l_orderkey", "l_linenumber", F.col("u.llm_cost_amount").cast("double").alias("amount"), F.col("u.llm_cost_currency").alias("currency"), F.col("u.llm_cost_status").alias("status"), F.size("u.usage_log_ids").alias("n_ids"))


@query("""
WITH i AS (SELECT l_orderkey % 97 AS document_id, CASE l_linenumber WHEN 1 THEN 'stock' WHEN 2 THEN 'agency' WHEN 3 THEN 'own_or_private_archive' WHEN 4 THEN NULL ELSE 'unheard' END AS category FROM lineitem WHERE l_orderkey % 97 < 60 AND (l_orderkey % 97 <> 7 OR l_linenumber > 3)),
s AS (SELECT document_id, count(*) FILTER (category IN ('stock', 'agency', 'own_or_private_archive')) AS captions, 3 * count(*) FILTER (category = 'stock') AS stock, count(*) FILTER (category = 'agency') AS agency FROM i GROUP BY document_id)
SELECT doc_id AS document_id, s.document_id IS NOT NULL AS stored, CASE WHEN s.document_id IS NOT NULL THEN captions WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS captions, least(15, CASE WHEN s.document_id IS NOT NULL THEN stock + agency WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END) AS penalty,
  CASE WHEN s.document_id IS NOT NULL THEN concat_ws(',', CASE WHEN agency > 0 THEN 'agency=' || agency END, CASE WHEN stock > 0 THEN 'stock=' || stock END) WHEN doc_id % 2 = 0 THEN 'agency=1,stock=3' ELSE '' END AS by_category
FROM documents LEFT JOIN s ON s.document_id = doc_id
""")
def photo_sources(t):
    """Lines of orders as pictures of the first documents; texts of the others end in captions, every second one."""
    said = F.when(F.col("doc_id") % 2 == 0, "prose\nfot. Shutterstock\nA. Nowak / PAP").otherwise("prose")
    images = t("lineitem").select((F.col("l_orderkey") % 97).alias("document_id"), F.element_at(F.array(F.lit("stock"), F.lit("agency"), F.lit("own_or_private_archive"), F.lit(None).cast("string"), F.lit("unheard")), F.least(F.col("l_linenumber").cast("int"), F.lit(5))).alias("category"), "l_linenumber")
    images = images.where((F.col("document_id") < 60) & ((F.col("document_id") != 7) | (F.col("l_linenumber") > 3)))
    out = evidence.photo_sources(t("documents").select(F.col("doc_id").alias("document_id"), said.alias("text"), F.lit("https://x.pl").alias("url")), images)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumn("by_category", told)


@query("SELECT vec_id AS document_id, m AS model, CASE WHEN vec_id % 7 = 0 AND m = 'b' THEN 2 ELSE 1 END AS part FROM embeddings, (VALUES ('a'), ('b')) v(m) WHERE NOT (vec_id % 5 = 0) AND NOT (vec_id % 3 = 0 AND m = 'a') UNION ALL SELECT vec_id, 'b', 2 FROM embeddings WHERE vec_id % 35 = 0")
def vectors_replaced(t):
    """Vectors of two models: those of one model, or of all, go; others come anew."""
    e = t("embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))
    stored = e.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    gone = e.where("document_id % 3 = 0").select("document_id", F.lit("a").alias("model")).unionByName(e.where("document_id % 5 = 0").select("document_id", F.lit(None).cast("string").alias("model")))
    fresh = e.where("document_id % 7 = 0").select("document_id", F.lit("b").alias("model"), F.lit(2).alias("part"), "vector")
    return mutations.replaced_vectors(stored.withColumn("part", F.lit(1)), gone, fresh).select("document_id", "model", "part")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 < 2 THEN 'REVIEW' WHEN o_orderstatus = 'P' THEN 'NEXT' WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'DONE' END AS state, CASE o_orderkey % 3 WHEN 2 THEN 'OTHER' ELSE 'NONE' END AS error FROM orders
""")
def stage_removed(t):
    """Orders as jobs, with two errors of a stage that is no more and one of another."""
    state = F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "P", "WAITING").otherwise("DONE")
    error = F.element_at(F.array(F.lit("E0"), F.lit("E1"), F.lit("OTHER")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return mutations.without_stage(t("orders").select("o_orderkey", state.alias("state"), error.alias("error")), ["E0", "E1"], "WAITING", "NEXT", "REVIEW")


_LINES = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'ignored' ELSE 'rule_added' END AS status FROM orders"


def _removed_lines(t):
    lines = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "ignored").otherwise("rule_added").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("reference"))
    marks = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("rule_added").alias("status"), F.lit("n").alias("note"), F.lit("rules:1").alias("reference")).where("id % 4 = 1")
    return lines, marks.unionByName(marks).unionByName(marks.withColumn("id", -F.col("id")))


@query(f"SELECT id, CASE WHEN status = 'pending' AND id % 4 = 1 THEN 'rule_added' ELSE status END AS status, CASE WHEN status = 'pending' AND id % 4 = 1 THEN 'rules:1' END AS reference FROM ({_LINES})")
def lines_reviewed(t):
    return mutations.marked_reviewed(*_removed_lines(t)).select("id", "status", "reference")


@query(f"SELECT id, status AS reason FROM ({_LINES}) WHERE status <> 'pending' AND id % 4 = 1 UNION ALL SELECT -id, 'missing' FROM ({_LINES}) WHERE id % 4 = 1")
def marks_rejected(t):
    return mutations.rejected_marks(*_removed_lines(t))
