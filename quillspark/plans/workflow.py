"""Persons, merges, imports, suggestions, vectors of runs, reported sources, extraction and parsed queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import extraction as X
from ..operators import workflow as W
from ..operators.entities import alias_index
from .registry import inline, query, shaped, shaped_sql

_PERSONS = [
    (1, "jan  KOWALSKI", 10, "resolved"), (2, "Jan Kowalsky", 10, "fuzzy"), (3, "Zenon {} Wójcik", None, "review"), (4, "J. K.", None, "review"), (5, "Nowakówna", 20, "resolved"), (6, "Anna Nowakk", 20, "fuzzy"), (7, "", None, "review"), (8, None, None, "review"), (9, "Jan Kowalsky", 10, "fuzzy"),
]


@query(shaped_sql([r[1:] for r in _PERSONS], "name, entity_id, status"))
def persons_resolved(t):
    names = inline(t, [(10, "Jan Kowalski"), (20, "Anna Nowak"), (30, "Józef Kot")], "entity_id int, name string")
    aliases = inline(t, [(10, "J. K."), (30, "J. K."), (20, "Nowakówna")], "entity_id int, name string")
    rows = shaped(t, [r[1:2] for r in _PERSONS], "name string").select(F.col("doc_id").alias("id"), "name")
    return W.persons(rows, alias_index(names, aliases), names, 0.6).withColumnRenamed("id", "doc_id")


@query("""
SELECT 'entity' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 10 <> 1
UNION ALL SELECT DISTINCT 'alias', CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END, CASE WHEN c_custkey % 10 < 2 THEN 'Shared' ELSE 'Own ' || c_custkey END FROM customer
UNION ALL SELECT 'alias', c_custkey - 1, c_name FROM customer WHERE c_custkey % 10 = 1
UNION ALL SELECT DISTINCT 'link', CASE WHEN o_custkey % 10 = 1 THEN o_custkey - 1 ELSE o_custkey END, (o_orderkey % 7)::VARCHAR FROM orders
""")
def organizations_merged(t):
    """One in ten goes into its neighbour, with whom it shares an alias."""
    k = F.col("c_custkey")
    entities = t("customer").select(k.alias("id"), F.col("c_name").alias("name"))
    aliases = t("customer").select(k.alias("id"), F.when(k % 10 < 2, "Shared").otherwise(F.concat(F.lit("Own "), k)).alias("name"))
    links = t("orders").select((F.col("o_orderkey") % 7).alias("document_id"), F.col("o_custkey").alias("id"))
    e, a, ls = W.merged(entities, aliases, links, t("customer").where("c_custkey % 10 = 1").select(k.alias("id"), (k - 1).alias("target")))
    return e.select(F.lit("entity").alias("kind"), "id", "name").unionByName(a.select(F.lit("alias").alias("kind"), "id", "name")).unionByName(ls.select(F.lit("link").alias("kind"), "id", F.col("document_id").cast("string").alias("name")))


@query("""
SELECT o_custkey AS document_id, o_orderstatus AS type, string_agg(c_name || ':' || n || ':' || coalesce(place, '') || ':' || coalesce(org, ''), ',' ORDER BY c_name) AS items FROM (
  SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) o JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT n_nationkey AS nk, n_name AS place FROM nation WHERE n_nationkey % 2 = 0) p ON nk = c_nationkey
  LEFT JOIN (SELECT c_custkey AS ck, 'org' || c_custkey AS org FROM customer WHERE c_custkey % 3 = 0) g ON ck = c_custkey GROUP BY 1, 2
""")
def entities_enriched(t):
    c = t("customer")
    names = c.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"))
    entities = t("orders").groupBy(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("type")).agg(F.count("*").alias("mentions")).join(names, "document_id")
    places = c.join(t("nation").where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("value"))
    orgs = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("org"), "c_custkey").alias("value"))
    out = W.enriched(entities, place=places, org=orgs)
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["name"], x["mentions"], F.coalesce(x["place"], F.lit("")), F.coalesce(x["org"], F.lit("")))), ","))


@query("SELECT event_id, user_id % 5 AS feed FROM events WHERE user_id % 5 < 3 AND ts >= TIMESTAMP '2024-01-01' + INTERVAL (user_id % 5 * 7) DAY")
def auto_import(t):
    feeds = t("region").sparkSession.range(4).select(F.col("id").alias("feed"), F.when(F.col("id") < 3, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id * 7 AS int))")).alias("import_from"))
    items = t("events").select("event_id", (F.col("user_id") % 5).alias("feed"), F.col("ts").alias("published_at"))
    return W.imported(items, feeds).select("event_id", "feed")


@query("""
SELECT o_orderkey AS document_id, o_orderstatus AS kind, 'old' AS image FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderstatus = 'O') AND NOT (o_orderkey % 4 = 1 AND o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 'O', 'new' || k FROM orders, (VALUES (1), (2)) v(k) WHERE o_orderkey % 4 = 0
""")
def images_replaced(t):
    """One document in four gets two new pictures of one kind, one in four loses those of another; pictures of other kinds stay."""
    o = t("orders").withColumnRenamed("o_orderkey", "document_id")
    old = o.select("document_id", F.col("o_orderstatus").alias("kind"), F.lit("old").alias("image"))
    new = o.where("document_id % 4 = 0").select("document_id", F.lit("O").alias("kind"), F.explode(F.array(F.lit("new1"), F.lit("new2"))).alias("image"))
    return W.replaced(old, new, ["document_id", "kind"], o.where("document_id % 4 = 1").select("document_id", F.lit("F").alias("kind")))


@query("SELECT DISTINCT o_custkey AS document_id, 0 AS group_id FROM orders UNION SELECT user_id, user_id % 3 FROM events WHERE value >= 50 AND event_type <> 'error'")
def suggestions_applied(t):
    links = t("orders").select(F.col("o_custkey").alias("document_id"), F.lit(0).cast("long").alias("group_id")).distinct()
    status = F.when(F.col("event_type") == "error", "rejected").otherwise("open")
    return W.applied_suggestions(links, t("events").select(F.col("user_id").alias("document_id"), (F.col("user_id") % 3).alias("group_id"), F.col("value").alias("confidence"), status.alias("status")), 50.0)


_RUN = [
    ("TEMAT", "approved", "Intro {}\n[img1: x]\nPodpis\n# A\n**jeden** [dwa](u)", ["Intro {}", "A", "jeden dwa"]),
    ("REKLAMA", "approved", "nic", []),
    ("TEMAT", "approved", "tylko {}", ["tylko {}"]),
    ("TEMAT", "draft", "nic", []),
    ("TEMAT", "approved", "Fot. Jan / PAP", []),
]


@query(shaped_sql([(k, n, text, True) for k, r in enumerate(_RUN) for n, text in enumerate(r[3])], "part, text, unit", len(_RUN)))
def run_vectors(t):
    chunks = shaped(t, [r[:3] for r in _RUN], "type string, status string, text string").withColumnRenamed("doc_id", "chunk_id").drop("shape")
    out = W.vectors_of_run(chunks, 4)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    key = F.split("key", ":")
    return out.select(F.get(key, F.lit(0)).cast("long").alias("doc_id"), F.get(key, F.lit(1)).cast("int").alias("part"), "text", F.round(norm, 4).isin(0.0, 1.0).alias("unit"))



_REPORTS = [
    (1, "Jak podała agencja AFP, wojna {} trwa. AFP poinformowała też o rozmowach.", [("AFP", "AFP", "Jak podała agencja AFP, wojna {} trwa.")]),
    (2, "NYT to gazeta. France 24 i New York Times ujawniły nic.\nNew York Times ujawnił plan!", [("The New York Times", "New York Times", "New York Times ujawnił plan!")]),
    (3, "W AFPX podano. AFP milczy.", []),
    (4, "france24 informuje, że nyt opisał {}", [("France24", "France24", "france24 informuje, że nyt opisał {}"), ("The New York Times", "NYT", "france24 informuje, że nyt opisał {}")]),
    (5, "", []),
    (6, None, []),
]


@query(shaped_sql([(i - 1, *f) for i, _, found in _REPORTS for f in found], "source, mention, evidence", len(_REPORTS)))
def reported_sources(t):
    rows = shaped(t, [r[1:2] for r in _REPORTS], "text string").select(F.col("doc_id").alias("id"), "text")
    return W.reported_sources(rows).withColumnRenamed("id", "doc_id")


_URLS = [
    ("https://www.onet.pl/{}", "onet", True), ("http://FAKT.pl", "onet", True), ("https://sport.o2.pl:8080/x", "wp", True), ("https://{}.example.org", None, True), ("ftp://wp.pl/x", "wp", False), ("http://localhost/x", None, False), ("http://127.0.0.1:80", None, False), ("https://10.1.2.3/a", None, False), ("https://172.20.0.1", None, False),
    ("https://172.32.0.1", None, True), ("http://[::1]/", None, False), ("http://[fe80::1]/", None, False), ("http://user@192.168.0.1/", None, False), ("http://169.254.169.254/meta", None, False), ("https://100.64.1.1", None, False), ("https:///x", None, False), ("", None, False), (None, None, False),
]


@query(shaped_sql(_URLS, "url, portal, allowed"))
def url_guards(t):
    return shaped(t, [r[:1] for r in _URLS], "url string").select("doc_id", "url", X.portal(F.col("url")).alias("portal"), X.may_fetch(F.col("url")).alias("allowed"))


_PAGES = [
    ("nav\n# Portal główny\na\nb\nc\nd\n# Tytuł artykułu\nPierwsze zdanie.\nŚrodek {}\nOstatnie zdanie.\n\n## Stopka", "b\nc\nd\n# Tytuł artykułu\nPierwsze zdanie.\nŚrodek {}\nOstatnie zdanie.\n\n## Stopka", "Pierwsze zdanie.\nŚrodek {}\nOstatnie zdanie.", "Pierwsze zdanie.\nŚrodek {}\nOstatnie zdanie."),
    ("a\nb\nc\nd\ne", "c\nd\ne", None, None),
    ("# Krótki\nPierwsze  zdanie. Dalej\nx\nOstatnie zdanie.\nreklama {}", "x\nOstatnie zdanie.\nreklama {}", None, "Pierwsze  zdanie. Dalej\nx\nOstatnie zdanie."),
    ("Ostatnie zdanie.\nPierwsze zdanie.", "Ostatnie zdanie.\nPierwsze zdanie.", None, None),
]


@query(shaped_sql([(r[0], r[1], r[2] or r[3], r[3]) for r in _PAGES], "page, trimmed, to_footer, to_sentence"))
def article_borders(t):
    page = F.col("page")
    cut = lambda *footers: X.between(page, F.lit("Pierwsze zdanie."), F.lit("Ostatnie  zdanie."), footers)
    return shaped(t, [r[:1] for r in _PAGES], "page string").select("doc_id", "page", X.without_navigation(page).alias("trimmed"), cut("## Stopka").alias("to_footer"), cut().alias("to_sentence"))


_CHAPTERS = [
    ("wstęp {}\n\n## Jeden\ntekst {}\n\ndalej\n\nDwa\ntekst b", ["Jeden", "Dwa"], ["wstęp {}", "## Jeden\ntekst {}\n\ndalej", "Dwa\ntekst b"]),
    ("bez\n\nrozdziałów", ["Jeden", "Dwa"], None),
    ("Jeden\nx\n\ny", ["Jeden", "Dwa", "Trzy"], None),
    ("Jeden\nx\n\ny", ["Jeden", "Dwa"], ["Jeden\nx\n\ny"]),
    ("x", [], None),
]


@query(shaped_sql([(None if r[2] is None else " || ".join(r[2]),) for r in _CHAPTERS], "chunks"))
def chapter_chunks(t):
    rows = shaped(t, [r[:2] for r in _CHAPTERS], "text string, titles array<string>")
    chunks = X.chapter_chunks(F.col("text"), F.col("titles"), 1000)
    return rows.select("doc_id", F.when(chunks.isNotNull(), F.array_join(chunks, " || ")).alias("chunks"))


def _asked(**fields) -> str:
    return json.dumps(fields, ensure_ascii=False)


_QUERIES = [
    (_asked(query=" wojna {} ", published_on_from="2024-05-01", published_on_to="2024-01-01", languages=["pl", "en"]), "wojna {}", "2024-01-01", "2024-05-01", None, None, "pl,en", "relevance", True, None),
    (_asked(subject_period_start_year=1945, subject_period_end_year=1939, sort="published_desc"), None, None, None, 1939, 1945, None, "published_desc", True, None),
    (_asked(query="", published_on_from="2024-02-30"), None, None, None, None, None, None, "relevance", False, "published_on"),
    (_asked(query="x", sort="best"), "x", None, None, None, None, None, "best", False, "sort"),
    (_asked(query="x", languages=["pl", "polski"]), "x", None, None, None, None, "pl,polski", "relevance", False, "languages"),
    (_asked(query="x", subject_period_start_year=1900, sort=""), "x", None, None, 1900, None, None, "relevance", False, None),
    ("[1]", None, None, None, None, None, None, "relevance", False, "response"),
    ("{broken", None, None, None, None, None, None, "relevance", False, "response"),
    ("", None, None, None, None, None, None, "relevance", False, "response"),
    (None, None, None, None, None, None, None, "relevance", False, "response"),
]


@query(shaped_sql(_QUERIES, "payload, query, published_from, published_to, first_year, last_year, languages, sort, swapped, error"))
def parsed_queries(t):
    return shaped(t, [r[:1] for r in _QUERIES], "payload string").withColumn("q", X.parsed_query(F.col("payload"))).select("doc_id", "payload", "q.*")
