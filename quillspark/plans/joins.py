"""Joins: outer, semi, anti, division, effective dates, counts with and without zero, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import counts_for, effective_at, with_all
from ..sources.catalog import small_side
from .registry import query

PRICES = [("view", "2024-01-01", "2024-01-10", "0.10"), ("view", "2024-01-10", None, "0.12"), ("click", "2024-01-01", None, "0.30"), ("purchase", "2024-01-05", "2024-01-20", "1.50")]
PRICES_SQL = ", ".join(f"('{k}', TIMESTAMP '{a}', {f"TIMESTAMP '{b}'" if b else 'CAST(NULL AS TIMESTAMP)'}, CAST({r} AS DECIMAL(12,6)))" for k, a, b, r in PRICES)


def prices(t):
    spark = t("region").sparkSession
    rows = spark.createDataFrame(PRICES, "event_type string, a string, b string, r string")
    return rows.select("event_type", F.col("a").cast("timestamp_ntz").alias("effective_from"), F.col("b").cast("timestamp_ntz").alias("effective_to"), F.col("r").cast("decimal(12,6)").alias("rate"))


@query("SELECT vec_id, e.label::BIGINT AS label, lang, n_chars FROM embeddings e LEFT JOIN documents ON vec_id = doc_id")
def left_join_docs(t):
    e, d = t("embeddings"), t("documents")
    return e.join(d, e["vec_id"] == d["doc_id"], "left").select("vec_id", e["label"].cast("long").alias("label"), "lang", "n_chars")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_join_lookup(t):
    places = t("nation").join(small_side(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("supplier").join(small_side(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_exists(t):
    hit = t("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return t("orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_not_exists(t):
    hit = t("lineitem").where(F.col("l_returnflag") == "R")
    return t("orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id AND label = 3 WHERE vec_id IS NULL")
def anti_model(t):
    d, e = t("documents").select("doc_id"), t("embeddings").where("label = 3")
    return d.join(e, d["doc_id"] == e["vec_id"], "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def not_in_scan(t):
    return t("customer").join(t("orders").where("o_custkey IS NOT NULL"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def division_all_topics(t):
    return with_all(t("lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')))")
def in_subquery_lookup(t):
    regions = t("region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = t("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query(f"SELECT event_id, p.rate::DOUBLE AS rate FROM events e LEFT JOIN (VALUES {PRICES_SQL}) p(event_type, a, b, rate) ON e.event_type = p.event_type AND a <= ts AND (b IS NULL OR ts < b)")
def price_asof(t):
    return effective_at(t("events").select("event_id", "event_type", "ts"), "ts", F.broadcast(prices(t)), ["event_type"]).select("event_id", F.col("rate").cast("double").alias("rate"))


@query(f"SELECT event_type, rate::DOUBLE AS rate, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) LEFT JOIN (SELECT * FROM (VALUES {PRICES_SQL}) p(event_type, a, b, rate) WHERE b IS NULL) USING (event_type)")
def price_current(t):
    """Each type of event with its number of events and the price now in force, if any."""
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(prices(t).where("effective_to IS NULL")), "event_type", "left").select("event_type", F.col("rate").cast("double").alias("rate"), "n")


@query("SELECT c_custkey, (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS rank FROM customer ORDER BY rank NULLS LAST, c_custkey DESC LIMIT 80")
def scalar_subquery_rank(t):
    ranks = t("orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("rank"))
    joined = t("customer").join(ranks, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "rank")
    return joined.orderBy(F.asc_nulls_last("rank"), F.desc("c_custkey")).limit(80)


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def counts_with_zero(t):
    return counts_for(t("customer").select("c_custkey", "c_name"), "c_custkey", t("orders"), "o_custkey", "n_orders")


@query("SELECT n_nationkey, n_name, count(*) AS n_customers FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY n_nationkey, n_name")
def counts_used_only(t):
    return counts_for(t("nation").select("n_nationkey", "n_name"), "n_nationkey", t("customer").where("c_acctbal > 9000"), "c_nationkey", "n_customers", zero=False)


@query("""
SELECT 'region-' || r_regionkey AS id, r_name AS label, 'region' AS kind FROM region UNION SELECT 'nation-' || n_nationkey, n_name, 'nation' FROM nation UNION SELECT 'supplier-' || s_suppkey, s_name, 'supplier' FROM supplier
""")
def graph_nodes(t):
    node = lambda df, kind, key, name: df.select(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("id"), F.col(name).alias("label"), F.lit(kind).alias("kind"))
    nodes = node(t("region"), "region", "r_regionkey", "r_name").unionByName(node(t("nation"), "nation", "n_nationkey", "n_name"))
    return nodes.unionByName(node(t("supplier"), "supplier", "s_suppkey", "s_name")).dropDuplicates(["id"])


@query("""
SELECT 'supplier-' || s_suppkey AS src, 'nation-' || s_nationkey AS dst, 'located' AS role FROM supplier
UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, 'part_of' FROM nation
""")
def graph_edges(t):
    edge = lambda df, a, key, b, to, role: df.select(F.concat(F.lit(f"{a}-"), F.col(key)).alias("src"), F.concat(F.lit(f"{b}-"), F.col(to)).alias("dst"), F.lit(role).alias("role"))
    located = edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located")
    return located.unionByName(edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "part_of"))
