"""Date phrases, years, relations, costs and JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from .registry import query, shaped, shaped_sql

PHRASES = [
    ("12 maja 1998 r.", "day", 1998, "1998-05-12", "1998-05-12"),
    ("17 września 1939", "day", 1939, "1939-09-17", "1939-09-17"),
    ("09.04", "day", 2026, "2026-04-09", "2026-04-09"),
    ("w marcu 1939 r.", "month", 1939, "1939-03-01", "1939-03-31"),
    ("luty 2024 r.", "month", 2024, "2024-02-01", "2024-02-29"),
    ("styczeń 2024 r.", "month", 2024, "2024-01-01", "2024-01-31"),
    ("sierpień 2023 r.", "month", 2023, "2023-08-01", "2023-08-31"),
    ("w marcu i kwietnia 2001", "month", 2001, "2001-04-01", "2001-04-30"),
    ("XIX wieku", "century", 1850, "1801-01-01", "1900-12-31"),
    ("lata 80.", "decade", 1980, "1980-01-01", "1989-12-31"),
    ("lata 90.", "decade", 1990, "1990-01-01", "1999-12-31"),
    ("lata siedemdziesiąte", "decade", 1970, "1970-01-01", "1979-12-31"),
    ("zaraz po II wojnie światowej", "era", 1945, None, None),
    ("w okresie PRL", "era", 1945, None, None),
    ("1918-1939", "year", 1918, "1918-01-01", "1939-12-31"),
    ("w latach 1918–1939", "year", 1918, "1918-01-01", "1939-12-31"),
    ("lata 1988 — 1998", "year", 1988, "1988-01-01", "1998-12-31"),
    ("1997", "year", 1997, "1997-01-01", "1997-12-31"),
    ("1914 rok", "year", 1914, "1914-01-01", "1914-12-31"),
    ("966", "year", 966, "0966-01-01", "0966-12-31"),
    ("1939-1918", None, None, None, None),
    ("31 lutego 2001", None, None, None, None),
    ("kiedyś {}", None, None, None, None),
]


@query(shaped_sql(PHRASES, "phrase, date_precision, sort_year, event_date, event_date_end"))
def date_phrases(t):
    rows = shaped(t, [p[:1] for p in PHRASES], "phrase string").withColumn("d", D.date_phrase(F.col("phrase"), F.lit("2026-04-09").cast("date")))
    return rows.select("doc_id", "phrase", "d.date_precision", "d.sort_year", F.col("d.event_date").cast("string").alias("event_date"), F.col("d.event_date_end").cast("string").alias("event_date_end"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN year(o_orderdate) END::BIGINT AS year FROM orders")
def year_coerce(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))).otherwise(F.lit("99999"))
    return t("orders").select("o_orderkey", D.year_of(raw).cast("long").alias("year"))


@query("""
WITH y AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, ['exact', 'before', 'after', 'between', 'around'][(o_orderkey % 5 + 1)::INT] AS r FROM orders)
SELECT o_orderkey, CASE r WHEN 'exact' THEN y WHEN 'after' THEN y WHEN 'between' THEN y - 2 WHEN 'around' THEN y - 5 END AS start, CASE r WHEN 'exact' THEN y WHEN 'before' THEN y WHEN 'between' THEN y WHEN 'around' THEN y + 5 END AS "end" FROM y
""")
def relation_bounds(t):
    kinds = F.array(*[F.lit(k) for k in ("exact", "before", "after", "between", "around")])
    y = F.year("o_orderdate")
    return t("orders").select("o_orderkey", D.relation_bounds(F.get(kinds, (F.col("o_orderkey") % 5).cast("int")), y, y - 2).alias("b")).select("o_orderkey", "b.start", "b.end")


_ANCHORS = [("Rozpad  ZSRR", 1991), ("Wejście Polski do NATO", 1999), ("Upadek muru berlińskiego", 1989), ("nieznane {}", None), ("początek II wojny światowej", 1939), ("KONIEC I WOJNY ŚWIATOWEJ", 1918), ("upadek muru {}", None), ("", None), (None, None), ("zamachy z 11 września", 2001), ("początek  zimnej  wojny", 1947)]


@query(shaped_sql(_ANCHORS, "anchor, year"))
def anchors(t):
    return shaped(t, [r[:1] for r in _ANCHORS], "anchor string").withColumn("year", D.anchor_year(F.col("anchor"))).drop("shape")


@query("""
SELECT l_orderkey, l_linenumber, round(l_partkey::DECIMAL(12,0) * round(l_quantity::DECIMAL(12,6), 2) * 0.000001::DECIMAL(7,6), 10)::DOUBLE AS cost FROM lineitem
""")
def token_cost(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", D.token_cost(F.col("l_partkey"), F.round(F.col("l_quantity").cast("decimal(12,6)"), 2)).cast("double").alias("cost"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS next FROM events")
def json_fields(t):
    broken = F.when(F.col("event_id") % 4 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    parsed = F.from_json(broken, "k BIGINT, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), parsed.alias("p")).select("event_id", "k", F.when(F.col("p._corrupt_record").isNull(), F.col("p.k") + 1).alias("next"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_recover(t):
    """A truncated array of objects: its complete objects are read."""
    cut = F.concat(F.lit("["), F.col("props"), F.lit(', {"k": 1'))
    whole = F.concat(F.regexp_extract(cut, r"(?s)^(\[.*\})", 1), F.lit("]"))
    return t("events").select("event_id", F.explode(F.from_json(whole, "array<struct<k:bigint>>")).alias("o")).select("event_id", "o.k")


@query("SELECT vec_id, i AS position, embedding[round_even(i * 63 / 8.0::DOUBLE, 0)::INT + 1]::DOUBLE AS point FROM embeddings, range(9) r(i)")
def polyline_simplify(t):
    """At most nine points of a line, evenly spaced, both ends kept."""
    n, most = F.size("embedding"), 9
    step = (n - 1) / F.lit(most - 1)
    places = F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * step).cast("int")))
    kept = F.transform(places, lambda i: F.get("embedding", i))
    return t("embeddings").select("vec_id", F.posexplode(kept).alias("position", "point")).select("vec_id", F.col("position").cast("long").alias("position"), F.col("point").cast("double").alias("point"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate AS t, make_date(year(o_orderdate)::INT, 3, 31) AS m, make_date(year(o_orderdate)::INT, 10, 31) AS o FROM orders),
z AS (SELECT o_orderkey, t, CASE WHEN t >= m - dayofweek(m)::INT + INTERVAL 1 HOUR AND t < o - dayofweek(o)::INT + INTERVAL 1 HOUR THEN 2 ELSE 1 END AS ahead FROM o)
SELECT o_orderkey, hour(t + to_hours(ahead)) >= 1 AS due FROM z
""")
def schedule_due(t):
    """A zone with summer time, which the SQL takes from its rule: the last Sundays of March and October, 1:00 UTC."""
    now = F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", D.due(now, F.lit("Europe/Warsaw"), F.lit(1), F.lit(None).cast("timestamp")).alias("due"))
