"""Windows, per-group picks, merges of rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import neighbours, top_per_group
from .registry import query


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_group(t):
    return top_per_group(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS previous_id, lead(doc_id) OVER (ORDER BY doc_id) AS next_id FROM documents WHERE lang = 'fr'")
def neighbours_by_id(t):
    return neighbours(t("documents").where("lang = 'fr'").select("doc_id"), "doc_id", 1000)


@query("SELECT doc_id FROM documents WHERE doc_id > 100 AND lang = 'de' ORDER BY doc_id LIMIT 1")
def next_after(t):
    return t("documents").where("doc_id > 100 AND lang = 'de'").select("doc_id").orderBy("doc_id").limit(1)


@query("SELECT doc_id FROM documents WHERE doc_id <> 3 AND lang = 'en' ORDER BY CASE WHEN doc_id < 3 THEN 0 ELSE 1 END, doc_id DESC LIMIT 1")
def next_wrap(t):
    return t("documents").where("doc_id <> 3 AND lang = 'en'").select("doc_id").orderBy(F.when(F.col("doc_id") < 3, 0).otherwise(1), F.desc("doc_id")).limit(1)


@query("""
SELECT l_orderkey, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS k FROM lineitem) WHERE k = 1
""")
def priority_pick(t):
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return top_per_group(t("lineitem"), ["l_orderkey", "l_suppkey"], [role, F.col("l_linenumber")]).select("l_orderkey", "l_suppkey", "l_returnflag")


@query("""
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k > 1 AND o_orderstatus IN ('O', 'P')
""")
def stale_duplicates(t):
    rank = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t("orders").withColumn("k", rank).where((F.col("k") > 1) & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("""
WITH s AS (SELECT c_nationkey, lower(c_mktsegment) AS key, c_mktsegment AS spelling, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2, 3)
SELECT c_nationkey, spelling, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) AS k FROM s) WHERE k = 1
""")
def spelling_vote(t):
    s = t("customer").where("c_mktsegment IS NOT NULL").groupBy("c_nationkey", F.lower("c_mktsegment").alias("key"), F.col("c_mktsegment").alias("spelling")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return top_per_group(s, ["c_nationkey"], [F.desc("n"), F.asc("first")]).select("c_nationkey", "spelling", "n")


@query("""
SELECT l_orderkey, l_suppkey, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS variants, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def merge_rows(t):
    merged = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("variants"), F.min("l_shipdate").alias("first_seen"))
    return merged.where("mentions > 1")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE role <> 'system'")
def renumber_positions(t):
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return t("conversations").where("role <> 'system'").select("conv_id", "turn", "role", position.alias("position"))


@query("""
WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM c)
SELECT conv_id, section::BIGINT AS section, min(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM g GROUP BY 1, 2
""")
def topic_sections(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    g = c.withColumn("section", F.sum("new").over(w))
    return g.groupBy("conv_id", "section").agg(F.min("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS source FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def rebuild_source(t):
    parts = t("conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("source"))


@query("""
WITH a AS (SELECT l_suppkey AS k, l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.flag, b.flag) AS flag, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.n <> b.n THEN 'count' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.flag = b.flag
""")
def entity_changes(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    of = lambda condition, n: t("lineitem").where(condition).groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias(n))
    both = of(F.col("l_shipdate") < cut, "old").join(of(F.col("l_shipdate") >= cut, "new"), ["k", "flag"], "full")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "count").otherwise("same")
    return both.select("k", "flag", change.alias("change"))
