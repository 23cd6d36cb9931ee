"""Listings, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import SearchFilters, apply_filters, escape_like, split_by_rules
from ..operators.relational import page
from .registry import query


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND doc_id >= 10 ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 50")
def doc_list_newest(t):
    docs = t("documents").select("doc_id", "lang", "source", "n_chars").where((F.col("lang") == "en") & (F.col("doc_id") >= 10))
    return page(docs, [F.desc("n_chars"), F.desc("doc_id")], 50, 2)


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(source), 'licensed under')")
def doc_search_substring(t):
    like = f"%{escape_like('licensed under')}%"
    return t("documents").where(F.col("text").ilike(like) | F.col("source").ilike(like)).select("doc_id", "lang")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND page_id > 20")
def url_prefix(t):
    return t("pages").where(F.startswith("url", F.lit("https://")) & (F.col("page_id") > 20)).select("page_id", "url")


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 OR l.toxic IS NULL")
def null_logic_filter(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id", "left").where(~F.coalesce(F.col("toxic") != 0, F.lit(False)))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def status_queue(t):
    return t("orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' AND user_id IS NOT NULL")
def date_range_window(t):
    ts = F.col("ts")
    return t("events").where((ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < F.lit("2024-01-08").cast("timestamp_ntz")) & F.col("user_id").isNotNull()).select("event_id", "user_id")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'notes' ELSE 'managed' END AS layer FROM documents WHERE source <> 'src3'")
def source_layer(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src3", "note").otherwise("page").alias("document_type"))
    kept = apply_filters(docs, SearchFilters(source_layer="managed"))
    return kept.select(F.col("id").alias("doc_id"), F.when(F.col("document_type") == "note", "notes").otherwise("managed").alias("layer"))


@query("""
WITH p AS (SELECT o_custkey, min(year(o_orderdate)) AS a, CASE WHEN max(year(o_orderdate)) < 2001 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM p WHERE o_custkey = c_custkey AND (b IS NULL OR b >= 1996) AND (a IS NULL OR a <= 1997))
""")
def period_overlap(t):
    years = t("orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.min(F.year("o_orderdate")).alias("start_year"), F.max(F.year("o_orderdate")).alias("last"))
    periods = years.select("document_id", "start_year", F.when(F.col("last") < 2001, F.col("last")).alias("end_year"))
    docs = t("customer").select(F.col("c_custkey").alias("id"), "c_name")
    return apply_filters(docs, SearchFilters(period_start=1996, period_end=1997), periods=periods).select(F.col("id").alias("c_custkey"), "c_name")


@query("""
WITH a AS (SELECT o_orderkey AS d, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0)
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM a WHERE d = o_orderkey AND lower(name) = 'customer#000000005')
OR (NOT EXISTS (SELECT 1 FROM a WHERE d = o_orderkey) AND contains(lower('by ' || coalesce((SELECT c_name FROM customer WHERE c_custkey = o_custkey), '')), 'customer#000000005'))
""")
def author_match_fallback(t):
    named = t("orders").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    docs = named.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("by "), F.coalesce("c_name", F.lit(""))).alias("byline"))
    authors = named.where((F.col("o_orderkey") % 3 == 0) & F.col("c_name").isNotNull()).select(F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("name"))
    return apply_filters(docs, SearchFilters(author_name="Customer#000000005"), authors=authors).select(F.col("id").alias("o_orderkey"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://th') THEN 'http://th' WHEN starts_with(url, 'https://an') THEN 'https://an' WHEN regexp_matches(html, '<title>De') THEN '<title>De' END AS ignored_by FROM pages")
def skip_filters_split(t):
    return split_by_rules(t("pages"), "url", "html", ["http://th", "https://an"], ["<title>De"]).select("page_id", "ignored_by")


@query("SELECT doc_id FROM documents WHERE list_contains(list_transform(string_split(lower(text), ' '), lambda x: trim(x)), 'idiot')")
def tag_contains(t):
    words = F.transform(F.split(F.lower("text"), " "), lambda w: F.trim(w))
    return t("documents").where(F.array_contains(words, "idiot")).select("doc_id")


@query("""
WITH r AS (SELECT * FROM (VALUES ('AFRICA', '*'), ('ASIA', 'NATION_8'), ('*', 'NATION_3')) v(region, nation))
SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.region = '*' OR r.region = r_name) AND (r.nation = '*' OR r.nation = n_name))
""")
def exclusion_rules(t):
    rules = [("AFRICA", "*"), ("ASIA", "NATION_8"), ("*", "NATION_3")]
    excluded = F.lit(False)
    for region, nation in rules:
        excluded = excluded | (F.lit(region == "*") | (F.col("r_name") == region)) & (F.lit(nation == "*") | (F.col("n_name") == nation))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where(~excluded)
    return t("supplier").join(places.select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query(r"SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) IN ('ththre.example.com', 'the.example.com') AS paid FROM pages")
def paywall_flag(t):
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    return t("pages").select("page_id", host.isin("ththre.example.com", "the.example.com").alias("paid"))


@query("""
SELECT count(*) FILTER (l_quantity < 0) AS negative_quantity, count(*) FILTER (l_discount NOT BETWEEN 0 AND 1) AS bad_discount,
count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag, count(*) FILTER (l_linenumber IS NULL OR l_linenumber < 1) AS bad_line FROM lineitem
""")
def quality_checks(t):
    return t("lineitem").agg(
        F.count_if(F.col("l_quantity") < 0).alias("negative_quantity"),
        F.count_if(~F.col("l_discount").between(0, 1)).alias("bad_discount"),
        F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("bad_flag"),
        F.count_if(F.col("l_linenumber").isNull() | (F.col("l_linenumber") < 1)).alias("bad_line"),
    )


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id DESC LIMIT 60")
def sort_nulls(t):
    joined = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return page(joined, [F.desc_nulls_first("quality"), F.desc("doc_id")], 60)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY CASE WHEN quality IS NULL THEN 1 ELSE 0 END, quality DESC, doc_id LIMIT 40")
def case_sort(t):
    joined = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return page(joined, [F.desc_nulls_last("quality"), F.asc("doc_id")], 40)


@query("SELECT o_orderkey, year(o_orderdate) AS sort_year FROM orders ORDER BY sort_year, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey LIMIT 70")
def timeline_order(t):
    when = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    rows = t("orders").select("o_orderkey", F.year("o_orderdate").alias("sort_year"), when.alias("at"))
    return page(rows, [F.asc("sort_year"), F.asc_nulls_last("at"), F.asc("o_orderkey")], 70).drop("at")


@query("SELECT event_type, user_id FROM (SELECT DISTINCT event_type, user_id FROM events WHERE value > 5) EXCEPT SELECT event_type, user_id FROM events WHERE value > 50")
def except_pairs(t):
    pairs = lambda least: t("events").where(F.col("value") > least).select("event_type", "user_id")
    return pairs(5).subtract(pairs(50))


@query("""
SELECT id, min(priority) AS priority FROM (SELECT user_id AS id, 0 AS priority FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'signup') GROUP BY id
""")
def union_dedup(t):
    hits = lambda kind, p: t("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), F.lit(p).alias("priority"))
    return hits("purchase", 0).unionByName(hits("signup", 1)).groupBy("id").agg(F.min("priority").alias("priority"))


@query("""
SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: NOT list_contains(list_transform(string_split(replace(text, 'the', ''), chr(10)), lambda y: trim(y)), x))))::BIGINT AS removed FROM documents
""")
def line_diff(t):
    lines = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return t("documents").select("doc_id", F.size(F.array_except(lines(F.col("text")), lines(F.replace("text", F.lit("the"), F.lit(""))))).cast("long").alias("removed"))


@query("""
WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS kinds FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(kinds, ['audit', 'view'])), lambda x: x <> 'error')), ',') AS kinds, list_has_any(kinds, ['purchase', 'signup']) AS wanted FROM u
""")
def set_maths(t):
    u = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    marked = F.array_union("k", F.array(F.lit("audit"), F.lit("view")))
    return u.select("user_id", F.array_join(F.array_sort(F.array_except(marked, F.array(F.lit("error")))), ",").alias("kinds"), F.arrays_overlap("k", F.array(F.lit("purchase"), F.lit("signup"))).alias("wanted"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_users(t):
    users = lambda kind: t("events").where(F.col("event_type") == kind).select("user_id")
    return users("purchase").intersect(users("error"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer")
def lookup_counts(t):
    first, *rest = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("nation", "region", "supplier", "customer")]
    for r in rest:
        first = first.unionByName(r)
    return first


@query("SELECT doc_id FROM documents d WHERE (lang IN ('fr', 'de')) AND n_chars BETWEEN 500 AND 3000 AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def filters_only(t):
    docs = t("documents").where(F.col("n_chars").between(500, 3000)).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    have = t("embeddings").select(F.col("vec_id").alias("document_id"))
    return apply_filters(docs, SearchFilters(languages=("fr", "de"), without_embedding=True), embeddings=have).select(F.col("id").alias("doc_id"))
