"""Footnotes, source lists, front matter, mail and site rules, over texts built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import names as N
from ..operators.sites import SiteRules, clean_pages, facilities
from .registry import query, shaped, shaped_sql


_NOTED = [
    ("Body 1\n³ Kowalski, 1999\n5 of them stay\n12 www.example.com/{}", [("3", "Kowalski, 1999", None, 7), ("12", "www.example.com/{}", "https://www.example.com/{}", 39)]),
    ("1 Short note {}.", [("1", "Short note {}.", None, 0)]),
    ("1 lower note {}.", []),
    ("123 Not a note {}.", []),
    ("¹² anything {}", [("12", "anything {}", None, 0)]),
    ("7 Ibidem, s. {}", [("7", "Ibidem, s. {}", None, 0)]),
    ("2 (https://e.com/{}), seen", []),
    ("", []),
    ("x\n4 Text from 2024 {} without end", [("4", "Text from 2024 {} without end", None, 2)]),
    (None, []),
    ("9 https://e.com/{}. and more", [("9", "https://e.com/{}. and more", "https://e.com/{}", 0)]),
]


@query(shaped_sql([(k, *n) for k, (_, found) in enumerate(_NOTED) for n in found], "marker, note, url, char_offset", len(_NOTED)))
def footnotes(t):
    rows = shaped(t, [r[:1] for r in _NOTED], "page string")
    return rows.select("doc_id", F.explode(M.footnotes(F.col("page"))).alias("f")).select("doc_id", "f.marker", F.col("f.text").alias("note"), "f.url", "f.char_offset")


_LISTED = [
    ("- not yet\n**Źródła:**\n\n* {} — x\n2. PAP\nplain line\n- over", [("{}", "{} — x"), ("PAP", "PAP")]),
    ("no list\n* {}", []),
    ("## Bibliografia\n1) A {}\n• B", [("A {}", "A {}"), ("B", "B")]),
    ("Literatura\nprose {}\n- late", []),
    ("", []),
    (None, []),
    ("*references:*\n- {}", [("{}", "{}")]),
    ("Źródła {}\n- x", []),
    ("ZRODLA\n\n\n- a — {} — c", [("a", "a — {} — c")]),
    ("Źródła:\n123. too long a number", []),
]


@query(shaped_sql([(k, *e) for k, (_, found) in enumerate(_LISTED) for e in found], "source_name, raw_entry", len(_LISTED)))
def press_bibliography(t):
    rows = shaped(t, [r[:1] for r in _LISTED], "page string")
    return rows.select("doc_id", F.explode(M.bibliography(F.col("page"))).alias("b")).select("doc_id", "b.source_name", "b.raw_entry")


@query("SELECT p_partkey, lower(p_brand) || '|news' AS tags, p_name AS body FROM part")
def front_matter(t):
    listed = F.concat(F.lit("---\ntitle: x\ntags:\n  - "), F.lower("p_brand"), F.lit("\n  - news\n---\n"), F.col("p_name"))
    inline = F.concat(F.lit("---\ntags: ["), F.lower("p_brand"), F.lit(", \"news\"]\n---\n"), F.col("p_name"))
    text = F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(inline)
    return t("part").select("p_partkey", F.array_join(M.front_matter_tags(text), "|").alias("tags"), M.body(text).alias("body"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'c' || c_custkey || '@example.com' END AS address, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer")
def mail_senders(t):
    k = F.col("c_custkey") % 3
    address = F.concat(F.lit("C"), F.col("c_custkey"), F.lit("@Example.com"))
    header = F.when(k == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), address, F.lit(">"))).when(k == 1, address).otherwise(F.lit("no address"))
    return t("customer").select("c_custkey", M.sender_address(header).alias("address"), M.sender_name(header).alias("name"))


@query("SELECT p_partkey, p_name AS text FROM part")
def mail_footers(t):
    text = F.concat(F.col("p_name"), F.lit("\n\nUnsubscribe: https://e.com/u/"), F.col("p_partkey"), F.lit(" (c) News.\n"))
    return t("part").select("p_partkey", M.without_footer(text, F.lit("Unsubscribe: https://e.com/u/0 (c) News.")).alias("text"))


@query("SELECT p_partkey, length(p_name) + 21 AS n, '   ' || p_name || '             end' AS text FROM part")
def blank_markers(t):
    text = F.concat(F.lit("***"), F.col("p_name"), F.lit("**[img12]__[x"), F.lit("end"))
    fixed = M.blank_markers(F.replace(text, F.lit("[x"), F.lit("  ")))
    return t("part").select("p_partkey", (F.length(fixed) + 2).cast("long").alias("n"), F.rpad(F.regexp_replace(fixed, "end$", ""), F.length("p_name") + 16, " ").alias("head")).select("p_partkey", "n", F.concat("head", F.lit("end")).alias("text"))


@query("""
SELECT page_id, CASE WHEN contains(url, 'th') THEN 'kept ' || page_id ELSE 'menu START kept ' || page_id || ' FOOT a FOOT b' END AS text FROM pages
""")
def site_rules(t):
    text = F.concat(F.lit("menu START kept "), F.col("page_id"), F.lit(" FOOT a FOOT b AD"))
    rules = {"th": SiteRules(remove_before=["START"], remove_after=[r"\s*FOOT"], remove_string_regexp=[r"\s*FOOT a$"]), "_global": SiteRules(remove_string=[" AD"])}
    return clean_pages(t("pages").select("page_id", "url", text.alias("text")), rules).select("page_id", "text")


@query("""
SELECT n_nationkey AS id, 'nuclear_power_plant' AS facility_type, 'Elektrownia jądrowa ' || n_name AS name, 2 AS mentions FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'power_plant', 'Elektrownia ' || n_name, 1 FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_nationkey, 'airport', 'Lotnisko ' || n_name, 1 FROM nation
""")
def facility_candidates(t):
    nuclear = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Elektrownia jądrowa "), F.col("n_name"), F.lit(". "))).otherwise("")
    text = F.concat(nuclear, F.lit("Blisko elektrowni "), F.col("n_name"), F.lit(" i na lotnisku "), F.col("n_name"), F.lit(", nie "), F.col("n_name"), F.lit("x"))
    docs = t("nation").select(F.col("n_nationkey").alias("id"), text.alias("text"))
    places = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("place"), F.array("n_name").alias("names"))
    return facilities(docs, places)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || ' \"a\" b' END AS name FROM supplier")
def quote_cleanup(t):
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))).otherwise(F.concat("s_name", F.lit(' "a" "b')))
    return t("supplier").select("s_suppkey", N.clean_quotes(raw).alias("name"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS matches, c_custkey % 3 = 0 AS truncated FROM customer")
def name_guards(t):
    mention = F.when(F.col("c_custkey") % 2 == 0, "Macrona").otherwise("demokratas")
    variants = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("Wilno"), F.lit("Wilnie"))).otherwise(F.array(F.lit("Wilno"), F.lit("Wil")))
    return t("customer").select("c_custkey", N.label_matches(mention, F.lit("Emmanuel Macron")).alias("matches"), N.is_truncated_lemma(F.lit("Wil"), variants).alias("truncated"))


_GUARDS = [
    (1, "Macrona", "Emmanuel Macron", "Brn", ["Brnem"], "A.", True, True, True),
    (2, "Lepen", "Marine Le Pen", "Wil", ["Wilno", "Wilnie"], "J. K.", True, True, True),
    (3, "demokratas", "Žemaitė", "Wil", ["Wilno", "Wil"], "J. Kowalski", False, False, False),
    (4, "JÓZEFA", "Jozef Kot", "Brn", ["Brna"], "j.", True, False, False),
    (5, "Li", "Li Wei", "BRN", ["brnem"], "", False, True, False),
    (6, "Ann", "Joanna-Maria X", "Wegr", ["Węgrzy"], "Jan", True, False, False),
    (7, "Al Bo", "Albo", "Brn", [], "J. K. Kot", False, False, False),
    (8, "", "Jan Kot", "Brn", ["Brnem", "Wilno"], "A. B. C.", False, False, True),
    (9, "Kowalski", "", "Gdańs", ["Gdańska", "GDAŃSKU"], "AB.", False, True, False),
    (10, "pan Kot", "Ewa Kotowska", "Rz", ["Rzym"], "A", True, True, False),
]


@query(shaped_sql([r[6:] for r in _GUARDS], "matches, truncated, initials"))
def name_guard_cases(t):
    rows = shaped(t, [r[1:6] for r in _GUARDS], "mention string, label string, base string, variants array<string>, surface string")
    guards = [N.label_matches(F.col("mention"), F.col("label")).alias("matches"), N.is_truncated_lemma(F.col("base"), F.col("variants")).alias("truncated"), N.is_initials(F.col("surface")).alias("initials")]
    return rows.select("doc_id", *guards)


@query("SELECT c_nationkey, mode AS spelling FROM (SELECT c_nationkey, c_mktsegment AS mode, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS k FROM customer GROUP BY 1, 2) WHERE k = 1")
def preferred_spellings(t):
    ordered = t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("s"))
    return ordered.select("c_nationkey", N.preferred_spelling(F.transform("s", lambda x: x["c_mktsegment"])).alias("spelling"))


@query()
def name_ratios(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.round(N.name_ratio(F.col("s_name"), F.concat_ws(", ", "n_name", "s_name")), 6).alias("ratio"))
