"""URL and HTML operators over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import urls as U
from .registry import query

_HOST = r"regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"
_ENTITIES = "replace(replace(replace(replace(replace(replace(%s, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(rf"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, {_HOST} AS host, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '{U.TRACKING}'))), '&') AS clean FROM p)
SELECT page_id, lower(scheme) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN clean <> '' THEN '?' || clean ELSE '' END AS canonical FROM q
""")
def url_canonical(t):
    return t("pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host(t):
    return t("pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(rf"SELECT regexp_extract({_HOST}, '([^.]+\.[^.]+)$', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def registrable(t):
    return t("pages").groupBy(U.registrable_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(rf"""
SELECT page_id, sha256(trim(regexp_replace({_ENTITIES % r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<br\s*/?>|</p>|</h[1-6]>|</li>', chr(10), 'g'), '<[^>]*>', '', 'g')"}, '\n\s*\n+', chr(10), 'g'))) AS digest FROM pages
""")
def html_strip(t):
    return t("pages").select("page_id", F.sha2(U.strip_html(F.col("html")), 256).alias("digest"))


@query(rf"""
SELECT page_id, {_ENTITIES % "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"} AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?i)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS description FROM pages
""")
def html_meta(t):
    c = F.col("html")
    return t("pages").select("page_id", U.html_title(c).alias("title"), U.html_lang(c).alias("lang"), U.meta(c, "description").alias("description"))


@query(r"""
SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label FROM pages
""")
def page_links(t):
    return t("pages").select("page_id", F.explode(U.links(F.col("html"))).alias("l")).select("page_id", "l.href", "l.label")


@query("""
WITH p AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS key FROM pages)
SELECT key, count(*) AS seen, min(page_id) AS first_seen, max(page_id) AS last_seen, max_by(url, page_id) AS url FROM p GROUP BY key
""")
def feed_upsert(t):
    p = t("pages").withColumn("key", F.regexp_replace("url", r"[?#].*$", ""))
    return p.groupBy("key").agg(F.count("*").alias("seen"), F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"), F.max_by("url", "page_id").alias("url"))


@query("SELECT page_id, 'doc ' || page_id AS label, url FROM pages")
def md_links(t):
    md = F.concat(F.lit("See [doc "), F.col("page_id"), F.lit("]("), F.col("url"), F.lit(") and ![img](x.png)"))
    return t("pages").select("page_id", F.explode(C.markdown_links(md)).alias("l")).select("page_id", "l.label", "l.url")


@query("SELECT page_id, 'https://doi.org/10.1000/x' || page_id AS url, 'doi' AS kind FROM pages UNION ALL SELECT page_id, 'https://pubmed.ncbi.nlm.nih.gov/' || (page_id + 100000), 'pmid' FROM pages UNION ALL SELECT page_id, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || (page_id + 5000), 'pmcid' FROM pages WHERE page_id % 2 = 0")
def citations(t):
    text = F.concat(F.lit("1. Study. doi:10.1000/x"), F.col("page_id"), F.lit("\n2. PMID: "), F.col("page_id") + 100000, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\n3. PMC"), F.col("page_id") + 5000)).otherwise(F.lit("")))
    kinds = {"doi": (r"\b(10\.\d{4,9}/[^\s\"<>)\]]+)", "https://doi.org/"), "pmid": (r"PMID:?\s*(\d+)", "https://pubmed.ncbi.nlm.nih.gov/"), "pmcid": (r"\b(PMC\d+)", "https://pmc.ncbi.nlm.nih.gov/articles/")}
    def of(kind: str, pattern: str, base: str):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.concat(F.lit(base), x).alias("url"), F.lit(kind).alias("kind")))

    found = F.concat(*[of(kind, *known) for kind, known in kinds.items()])
    return t("pages").select("page_id", F.explode(F.array_distinct(found)).alias("c")).select("page_id", "c.*")
