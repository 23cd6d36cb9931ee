"""Edits, lookups and batches over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import mutations as M
from ..operators.entities import most_similar
from .registry import query


@query("""
SELECT o_orderkey AS document_id, 'C' || o_custkey AS name, 'author' AS role, 1 AS position FROM orders WHERE o_orderkey % 4 > 1
UNION ALL SELECT o_orderkey, 'Clerk', 'editor', 1 FROM orders
UNION ALL SELECT o_orderkey, 'Jan Kot', 'author', 1 FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'Ewa ' || o_orderstatus, 'author', 2 FROM orders WHERE o_orderkey % 4 = 0
""")
def authors_replaced(t):
    """Of each four documents one gets authors (two of whom are alike), one loses them, two keep theirs."""
    o = t("orders").withColumnRenamed("o_orderkey", "document_id")
    links = o.select("document_id", F.concat(F.lit("C"), "o_custkey").alias("name"), F.lit("author").alias("role"), F.lit(1).cast("long").alias("position"))
    links = links.unionByName(o.select("document_id", F.lit("Clerk").alias("name"), F.lit("editor").alias("role"), F.lit(1).cast("long").alias("position")))
    names = F.when(F.col("document_id") % 4 == 0, F.array(F.lit(" Jan Kot"), F.concat(F.lit("Ewa "), "o_orderstatus"), F.lit("jan  kot"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    return M.set_authors(links, o.where("document_id % 4 < 2").select("document_id", names.alias("names")))


@query("SELECT 'events' AS kind, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def reopened(t):
    """Derived rows of the opened documents go from every table."""
    derived = {"events": t("events").select(F.col("user_id").alias("document_id")), "orders": t("orders").select(F.col("o_custkey").alias("document_id"))}
    left = M.without_documents(derived, t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("document_id")))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items()])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) WHEN s_suppkey % 3 = 1 THEN 'New ' || s_suppkey ELSE s_name END AS name, 'name' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_name, 'alias' FROM supplier WHERE s_suppkey % 3 = 1")
def renamed_with_alias(t):
    """A new spelling of the same name makes no alias; another name keeps the old one as an alias."""
    entities = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    changes = entities.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.concat(F.lit("New "), "id")).alias("name"))
    names, aliases = M.renamed(entities, entities.where("id % 3 = 1"), changes)
    return names.withColumn("kind", F.lit("name")).unionByName(aliases.withColumn("kind", F.lit("alias")))


@query("""
WITH p AS (SELECT n_nationkey AS id, n_regionkey AS site, n_nationkey % 7 = 0 AS own FROM nation), c AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT p.id, site, row_number() OVER (PARTITION BY site ORDER BY own DESC, coalesce(n, 0) DESC, p.id) AS k FROM p LEFT JOIN c ON p.id = c.id)
SELECT p.id, r.id AS survivor FROM p JOIN r ON p.site = r.site AND k = 1
""")
def publishers_merged(t):
    site = F.concat(F.lit("site"), F.col("n_regionkey"), F.lit(".com.pl"))
    domain = F.when(F.col("n_nationkey") % 7 == 0, site).otherwise(F.concat(F.lit("p"), F.col("n_nationkey"), F.lit("."), site))
    publishers = t("nation").select(F.col("n_nationkey").alias("id"), domain.alias("domain"))
    return M.merged_publishers(publishers, t("customer").select(F.col("c_nationkey").alias("publisher_id")))


@query("SELECT DISTINCT 'n' || (page_id % 40) || '.org' AS domain FROM pages WHERE page_id % 40 >= 10")
def publishers_missing(t):
    urls = t("pages").select(F.concat(F.lit("https://www.n"), F.col("page_id") % 40, F.lit(".org/"), F.col("page_id")).alias("url"))
    known = t("pages").sparkSession.range(10).select(F.concat(F.lit("n"), "id", F.lit(".org")).alias("domain"))
    return M.missing_publishers(urls, known)


@query("SELECT page_id AS ask, CASE WHEN page_id % 2 = 0 THEN page_id // 2 END AS id FROM pages")
def documents_by_url(t):
    """Asked by an address with another case, port, order of parameters and tracking."""
    k = F.col("page_id")
    stored = t("pages").select(k.alias("id"), F.concat(F.lit("https://e.com/d/"), k, F.lit("?a=1&b=2")).alias("url"))
    asked = t("pages").select(k.alias("ask"), F.when(k % 2 == 0, F.concat(F.lit("HTTPS://E.com:443/d/"), F.floor(k / 2), F.lit("/?b=2&utm_source=x&a=1#top"))).otherwise("https://e.com/none").alias("url"))
    return M.by_url(asked, stored.unionByName(t("region").sparkSession.createDataFrame([(0, "https://e.com/d/0?a=1&b=2")], "id long, url string")))


@query("""
WITH r AS (SELECT * FROM (VALUES (1, 'O', 3, 7, 'mine'), (2, 'O', 3, NULL, 'all O'), (3, 'F', 1, NULL, 'first F'), (4, 'F', 1, 8, 'never')) v(pos, type, key, author, target))
SELECT o_orderkey AS id, (SELECT min_by(target, pos) FROM r WHERE r.type = o_orderstatus AND r.key = o_orderkey % 5 AND (author IS NULL OR author = o_custkey % 10)) AS target FROM orders
""")
def rule_in_order(t):
    rules = t("region").sparkSession.createDataFrame([(1, "O", 3, 7, "mine"), (2, "O", 3, None, "all O"), (3, "F", 1, None, "first F"), (4, "F", 1, 8, "never")], "position int, type string, key int, author int, target string")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 5).alias("key"), (F.col("o_custkey") % 10).alias("author"))
    return M.first_rule(rows, F.broadcast(rules))


@query("WITH c AS (SELECT lang, count(*) AS trust FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) SELECT doc_id, documents.lang AS lang, coalesce(trust, 0) AS trust FROM documents LEFT JOIN c ON documents.lang = c.lang ORDER BY coalesce(trust, 0) DESC, n_chars, doc_id LIMIT 50")
def prioritised_batch(t):
    counts = t("documents").where("doc_id % 2 = 0").groupBy("lang").agg(F.count("*").alias("trust"))
    docs = t("documents").select("doc_id", "lang", "n_chars")
    return M.prioritised(docs, [F.asc("n_chars"), F.asc("doc_id")], counts, "lang", 50).select("doc_id", "lang", F.coalesce("trust", F.lit(0)).alias("trust"))


@query("""
WITH m AS (SELECT user_id, event_type, count(*) AS mentions FROM events GROUP BY 1, 2), l AS (SELECT DISTINCT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'refund' END AS raw, CASE WHEN c_custkey % 3 = 0 THEN 'author' ELSE 'mentioned' END AS role FROM customer)
SELECT c_custkey, role, coalesce(mentions, 0) AS mentions FROM l LEFT JOIN m ON c_custkey = user_id AND raw = event_type ORDER BY role <> 'author', coalesce(mentions, 0) DESC, c_custkey LIMIT 100
""")
def documents_by_person(t):
    """Authors first, then by how often the person is mentioned under the linked name; no mention counts 0."""
    mentions = t("events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("e")).agg(F.count("*").alias("n"))
    k = F.col("c_custkey")
    links = t("customer").select("c_custkey", F.when(k % 2 == 0, "click").otherwise("refund").alias("raw"), F.when(k % 3 == 0, "author").otherwise("mentioned").alias("role"))
    joined = links.join(mentions, (k == F.col("u")) & (F.col("raw") == F.col("e")), "left").select("c_custkey", "role", F.coalesce("n", F.lit(0)).alias("mentions"))
    return joined.orderBy((F.col("role") != "author"), F.desc("mentions"), "c_custkey").limit(100)


@query("SELECT doc_id FROM documents d WHERE (length(text) > 100 OR length(source) > 100) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def text_not_reviewed(t):
    has_text = (F.length("text") > 100) | (F.length("source") > 100)
    return t("documents").where(has_text).select("doc_id").join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT c_nationkey AS group_id, count(*) AS people, count(*) FILTER (c_acctbal < 0) AS owing, count(DISTINCT c_mktsegment) AS segments, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS suppliers FROM customer GROUP BY c_nationkey
""")
def group_usage(t):
    people = t("customer").groupBy(F.col("c_nationkey").alias("group_id")).agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("owing"), F.count_distinct("c_mktsegment").alias("segments"))
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("group_id")).agg(F.count("*").alias("suppliers"))
    return people.join(suppliers, "group_id", "left").withColumn("suppliers", F.coalesce("suppliers", F.lit(0)))


@query("""
SELECT doc_id, 'embeddings' AS part, (SELECT count(*) FROM embeddings WHERE vec_id = doc_id) AS n FROM documents UNION ALL SELECT doc_id, 'labels', (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) FROM documents d UNION ALL SELECT doc_id, 'pages', (SELECT count(*) FROM pages WHERE page_id = doc_id) FROM documents
""")
def enrichment_status(t):
    """Rows of each derived table for every document, zero where there are none; each table is counted once."""
    parts = [("embeddings", "vec_id"), ("labels", "doc_id"), ("pages", "page_id")]
    counts = reduce(DataFrame.unionByName, [t(name).select(F.col(key).alias("d"), F.lit(name).alias("p")) for name, key in parts]).groupBy("d", "p").agg(F.count("*").alias("n"))
    every = t("documents").select("doc_id", F.explode(F.array(*[F.lit(name) for name, _ in parts])).alias("part"))
    return every.join(counts, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p")), "left").select("doc_id", "part", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT * FROM (PIVOT (SELECT year(o_orderdate) AS year, o_orderpriority, o_totalprice FROM orders) ON o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') USING count(o_totalprice) GROUP BY year)")
def yearly_pivot(t):
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    wide = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderpriority", kinds).agg(F.count("o_totalprice"))
    return wide.select("year", *[F.coalesce(f"`{k}`", F.lit(0)).alias(k) for k in kinds])


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE lang = 'fr') > 20 AS has_more FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 20")
def page_with_more(t):
    """One row more than asked tells whether there is a next page; it is not returned."""
    ask = 20
    rows = t("documents").where("lang = 'fr'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(ask + 1)
    return rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("k"), "doc_id", "n_chars"))).alias("r")).select((F.size("r") > ask).alias("has_more"), F.explode(F.slice("r", 1, ask)).alias("x")).select("x.doc_id", "x.n_chars", "has_more")


@query("""
WITH f AS (SELECT s_suppkey, trim(lower(CASE WHEN s_suppkey % 2 = 0 THEN 'ŹRÓDŁO ' || (s_suppkey % 30) ELSE s_name END)) AS name FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 30 < 25 THEN s_suppkey % 30 END AS organisation FROM f
""")
def sources_linked(t):
    """Sources and organisations meet on folded names: case and marks don't matter."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ŹRÓDŁO  "), F.col("s_suppkey") % 30)).otherwise(F.col("s_name"))
    organisations = t("nation").select(F.col("n_nationkey").cast("long").alias("organisation"), fold(F.concat(F.lit("zrodlo "), F.col("n_nationkey"))).alias("key"))
    return t("supplier").select("s_suppkey", fold(name).alias("key")).join(organisations, "key", "left").select("s_suppkey", "organisation")


@query("WITH a AS (SELECT s_nationkey % 7 AS name, count(*) AS meanings FROM supplier GROUP BY 1) SELECT name::BIGINT AS name, meanings, meanings > 1 AS ask FROM a")
def ambiguous_names(t):
    """A name that means several entities blocks a search until the user is asked."""
    return t("supplier").groupBy((F.col("s_nationkey") % 7).cast("long").alias("name")).agg(F.count("*").alias("meanings")).withColumn("ask", F.col("meanings") > 1)


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 60")
def review_queue(t):
    """What waits for a decision, oldest first, with its context."""
    waiting = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = waiting.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "c_name", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(60)


@query("SELECT c_custkey, s_name AS similar FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND c_custkey % 2 = 0")
def similar_tool(t):
    """The most similar known name above a threshold; none for names that resemble nothing."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("c_name", "^Customer", "SUPPLIER")).otherwise(F.concat(F.lit("unlike "), "c_custkey"))
    asked = t("customer").select("c_custkey", name.alias("name"))
    best = most_similar(asked, t("supplier").select(F.col("s_name").alias("name")), 0.95)
    return asked.join(best, "name", "left").select("c_custkey", F.col("other").alias("similar"))
