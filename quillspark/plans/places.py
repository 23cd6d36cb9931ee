"""Place names, over mentions of several shapes and over texts that hold planted names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as P
from ..functions.text import MARKED, PLAIN
from ..operators import places as O
from .registry import inline, query, shaped, shaped_sql

_COUNTRIES = [
    ("Polska", "Polska"), ("polskiej", "Polska"), ("polski", "Polska"), ("Rozmowy z {} Polską", None), ("Iranem", "Iran"), ("Rosjanie", "Rosja"), ("Ukraińcami", "Ukraina"), ("włoskiej", "Włochy"), ("Włoszczowa", None),
    ("Zjednoczonych Emiratach Arabskich", "Zjednoczone Emiraty Arabskie"), ("Emiraty", "Zjednoczone Emiraty Arabskie"), ("Korea {}", None), ("Koreą Północną", "Korea Północna"), ("Sudanie Południowym", "Sudan Południowy"), ("Sudan", "Sudan"),
    ("Dominikana", "Dominikana"), ("Malediwów", "Malediwy"), ("Republika Południowej Afryki", "Republika Południowej Afryki"), ("Papua-Nowa Gwinea", "Papua-Nowa Gwinea"), ("Gwinei Bissau", "Gwinea Bissau"), (" niger ", "Niger"), ("Nigeryjczyk {}", None), ("nigerii", "Nigeria"), ("USA", "Stany Zjednoczone"), ("Polska.", None), ("-Polska", None), ("", None), ("   ", None), (None, None),
]


@query(shaped_sql(_COUNTRIES, "mention, country"))
def country_names(t):
    return shaped(t, [r[:1] for r in _COUNTRIES], "mention string").withColumn("country", O.canonical_name(F.col("mention"), P.COUNTRIES)).drop("shape")


_PLACES = [
    ("Omdurmanie", "Omdurman", None, None, None, None), ("Al-Fasziru", "Al-Faszir", None, None, None, None), ("al faszir", "Al-Faszir", None, None, None, None), ("Al-Ubajidem", "Al-Ubajjid", None, None, None, None), ("Ofensywa {} na Al-Faszir trwa", None, None, None, None, None),
    ("Morzu Czerwonym", None, "Morze Czerwone", None, None, None), ("Zatoce Perskiej", None, "Zatoka Perska", None, None, None), ("Cieśniny Ormuz", None, "Cieśnina Ormuz", None, None, None), ("Ormuz", None, None, None, None, None),
    ("Kordofanie Północnym", None, None, "Kordofan Północny", None, None), ("Sahelu", None, None, None, "Sahel", 15.0), ("Bliskim Wschodzie", None, None, None, "Bliski Wschód", 30.0), ("Lewancie", None, None, None, "Lewant", 34.0),
    ("Afryce Subsaharyjskiej", None, None, None, "Afryka Subsaharyjska", 2.0), ("Azji Południowo-Wschodniej", None, None, None, "Azja Południowo-Wschodnia", 5.0), ("Ameryka Północna", None, None, None, None, None), ("Warszawa {}", None, None, None, None, None),
]


@query(shaped_sql(_PLACES, "mention, city, water, province, region, latitude"))
def place_names(t):
    rows = shaped(t, [r[:1] for r in _PLACES], "mention string")
    m = F.col("mention")
    named = rows.select("doc_id", "mention", O.canonical_name(m, P.CITIES).alias("city"), O.canonical_name(m, P.WATERS).alias("water"), O.canonical_name(m, P.PROVINCES).alias("province"), O.canonical_name(m, P.REGIONS).alias("region"))
    points = inline(t, [(name, float(latitude)) for name, (latitude, _) in P.REGION_POINTS.items()], "region string, latitude double")
    return named.join(F.broadcast(points), "region", "left")


_EDGES = [
    ("Al-Faszirze {} Emiraty", "Al-Faszirze {}", "Zjednoczone Emiraty Arabskie"), ("Polska Kijów", "Kijów", "Polska"), ("Chartum Zjednoczone Emiraty Arabskie", "Chartum", "Zjednoczone Emiraty Arabskie"), ("Cieśnina Ormuz", None, None), ("Emiraty", None, None),
    ("Korea Północna", None, None), ("Białym Domu {} saudyjski", "Białym Domu {}", "Arabia Saudyjska"), ("Polska, Niemcy", "Polska", "Niemcy"), ("Kijów,  Ukraina", "Kijów", "Ukraina"), ("Polska -", None, None), ("", None, None), (None, None, None),
]


@query(shaped_sql(_EDGES, "mention, rest, country"))
def country_edges(t):
    return shaped(t, [r[:1] for r in _EDGES], "mention string").withColumn("s", O.split_country(F.col("mention"))).select("doc_id", "mention", "s.rest", "s.country")


_SURFACES = [("PL", "Polska", None), ("pl", None, None), ("UA", "Ukraina", None), ("Grecy", "Grecja", None), ("WŁOSI", "Włochy", None), ("Węgrzy", "Węgry", None), ("Polskę", "Polska", None), ("Turk", "Turcja", None), ("Al-Faszir", None, "El Fasher"), ("Kijów {}", None, None), ("RPA", "Republika Południowej Afryki", None)]


@query(shaped_sql(_SURFACES, "surface, country, ask"))
def surface_countries(t):
    asks = F.coalesce(*[F.when(F.col("surface") == k, F.lit(v)) for k, v in P.GEOCODE_NAMES.items()])
    return shaped(t, [r[:1] for r in _SURFACES], "surface string").select("doc_id", "surface", O.country_of(F.col("surface")).alias("country"), asks.alias("ask"))


_PAIRS = [("Dana", "Dan", "PROPN", True), (" dana ", "DAN", "noun", True), ("Dana", "Dan", "VERB", False), ("Dana", "Dan", None, False), ("Dana", "Dana", "PROPN", False), ("Ewa {}", "Dan", "NOUN", False), (None, "Dan", "NOUN", False)]


@query(shaped_sql(_PAIRS, "surface, lemma, pos, rejected"))
def rejected_pairs(t):
    return shaped(t, [r[:3] for r in _PAIRS], "surface string, lemma string, pos string").withColumn("rejected", O.rejected(F.col("surface"), F.col("lemma"), F.col("pos"))).drop("shape")


#: What the query plants at the end of every text.
PLANTED = ("w Koreą-Północną", "do Polski, Ukrainy", "stan zjednoczony", "Sudanie Południowym", "korea. polnocna", "RPA", "rpax nic", "Saint   Lucia")


def _pattern(form: str) -> str:
    return r"[\s-]+".join(rf"\b{w[:-1]}\w*" if w.endswith("*") else rf"\b{w}\b" for w in form.split())


_VALUES = ", ".join(f"('{name}', '{_pattern(form)}')" for name, forms in P.COUNTRIES.items() for form in forms)


@query(f"""
WITH p AS (SELECT * FROM (VALUES {_VALUES}) v(name, pattern)),
d AS (SELECT doc_id AS id, translate(lower(translate(text || ' ' || ([{', '.join(f"'{x}'" for x in PLANTED)}])[doc_id % {len(PLANTED)} + 1], '{MARKED}', '{PLAIN}')), '', '') AS text FROM documents)
SELECT DISTINCT id, name FROM d JOIN p ON regexp_matches(text, pattern)
""")
def countries_in_texts(t):
    """Countries that the texts name, each text with one of several planted phrases behind it."""
    planted = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    return O.names_in(t("documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", planted).alias("text")), P.COUNTRIES)


@query("""
SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN 'Polska' WHEN 1 THEN 'Kijów' ELSE 'Polska' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' ELSE 'a' END AS variants, (CASE c_custkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 2 END)::BIGINT AS mentions FROM customer
UNION ALL SELECT c_custkey, 'Ukraina', 'b', 5 FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, 'Niemcy', 'a', 2 FROM customer WHERE c_custkey % 3 = 1
""")
def places_merged(t):
    """Each document has two mentions, which of one in three are forms of one name."""
    k = F.col("c_custkey")
    row = lambda names, variants, n: t("customer").select(k.alias("document_id"), F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int")).alias("name"), F.array(*map(F.lit, variants)).alias("variants"), F.lit(n).cast("long").alias("mentions"))
    both = row(("Polską", "Niemcami", "polskie"), ("a", "a"), 2).unionByName(row(("Polską", "Kijów", "Ukraińcy"), ("b",), 5))
    return O.merged_places(both, P.COUNTRIES).withColumn("variants", F.array_join("variants", ","))


@query("SELECT 'hit' AS kind, s_nationkey AS query, count(*) AS n FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 2 UNION ALL SELECT 'miss', s_nationkey, 1 FROM supplier WHERE s_nationkey % 2 = 1 GROUP BY 2")
def geocode_cache(t):
    hits, misses = O.cached(t("supplier").select(F.col("s_nationkey").alias("query")), t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("query"), F.col("n_name").alias("place")))
    return hits.groupBy("query").agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "query", "n").unionByName(misses.select(F.lit("miss").alias("kind"), "query", F.lit(1).cast("long").alias("n")))


@query("""
SELECT o_orderkey AS document_id, 'miejsce-' || (o_custkey % 4) AS tag FROM orders WHERE o_custkey % 4 <> o_orderkey % 4
UNION ALL SELECT o_orderkey, 'kraj-nowa-zelandia' FROM orders WHERE o_orderkey % 5 > 0
""")
def tags_without_entity(t):
    o = t("orders").withColumnRenamed("o_orderkey", "document_id")
    tags = F.concat(F.lit("miejsce-"), F.col("o_custkey") % 4, F.lit(", kraj-nowa-zelandia,temat-x, kraj-nowa-zelandia"))
    found = o.select("document_id", (F.col("document_id") % 4).cast("string").alias("slug")).unionByName(o.where("document_id % 5 = 0").select("document_id", F.lit("nowa-zelandia").alias("slug")))
    return O.orphan_tags(o.select("document_id", tags.alias("tags")), found)
