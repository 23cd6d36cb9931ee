"""Queues, upserts, watermarks and debouncing in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incremental import claim, insert_missing, recover, replace_for, sessions, upsert_latest
from .registry import query

NOW = "1998-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def jobs(t):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return t("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("type"),
        status.alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").alias("available_at"),
        F.col("o_orderdate").alias("heartbeat_at"),
    )


@query(f"SELECT o_orderkey AS id, o_orderpriority AS type FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{NOW}' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') ORDER BY o_orderdate, o_orderkey LIMIT 25")
def job_claim(t):
    return claim(jobs(t), now(), ["1-URGENT", "3-MEDIUM"], 25).select("id", "type")


@query(f"""
WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS s, o_orderkey % 4 AS attempt, o_orderdate AS due FROM orders), k AS (SELECT *, s = 'running' AND due < TIMESTAMP '{NOW}' - INTERVAL 120 SECOND AS stale FROM j)
SELECT id, CASE WHEN stale AND attempt >= 3 THEN 'failed' WHEN stale THEN 'queued' ELSE s END AS status, CASE WHEN stale AND attempt < 3 THEN TIMESTAMP '{NOW}' + to_seconds(CASE WHEN attempt <= 1 THEN 30 ELSE 120 END) ELSE due END AS available_at FROM k
""")
def job_recover(t):
    return recover(jobs(t), now()).select("id", "status", "available_at")


@query("SELECT key, min(event_id) AS first_id FROM (SELECT event_type || ':' || user_id AS key, event_id FROM events) GROUP BY key")
def idempotent_enqueue(t):
    asked = t("events").select(F.concat_ws(":", "event_type", "user_id").alias("key"), "event_id")
    return asked.groupBy("key").agg(F.min("event_id").alias("first_id"))


@query("WITH w AS (SELECT max(ts)::DATE AS d FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20') SELECT event_id, event_type FROM events, w WHERE ts >= d")
def watermark_pull(t):
    e = t("events")
    done = e.where((F.col("event_type") != "error") & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    # the mark is one value, read first, so that the filter on it reaches the scan
    mark = done.agg(F.to_date(F.max("ts")).cast("timestamp_ntz")).first()[0]
    return e.where(F.col("ts") >= F.lit(mark)).select("event_id", "event_type")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY user_id, s
""")
def debounce_sessions(t):
    return sessions(t("events").select("user_id", "ts"), "user_id", "ts", 6 * 3600)


@query("""
WITH a AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), b AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(b.ts, a.ts) AS ts, CASE WHEN b.user_id IS NOT NULL THEN b.value ELSE a.value END AS value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""")
def upsert_latest_rows(t):
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    rows = t("events").select("user_id", "event_type", "ts", "value")
    return upsert_latest(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ["user_id", "event_type"], "ts")


@query("SELECT DISTINCT s_nationkey AS nation, 'supplier' AS origin FROM supplier WHERE s_nationkey < 15 UNION ALL SELECT DISTINCT c_nationkey, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 15)")
def insert_absent(t):
    old = t("supplier").where("s_nationkey < 15").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("origin")).distinct()
    new = t("customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin"))
    return insert_missing(old, new, ["nation"])


@query("""
SELECT conv_id, turn, role AS origin FROM conversations WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 0 AND role = 'system' UNION ALL SELECT conv_id, turn, 'refreshed' FROM conversations WHERE conv_id % 2 = 0 AND role = 'assistant'
""")
def refresh_derived(t):
    old = t("conversations").select("conv_id", "turn", F.col("role").alias("origin"))
    again = t("conversations").where("conv_id % 2 = 0 AND role = 'assistant'").select("conv_id", "turn", F.lit("refreshed").alias("origin"))
    out = replace_for(old, again, "conv_id", F.col("origin") == "system")
    # conversations without a reply keep what they had
    silent = t("conversations").where("conv_id % 2 = 0").join(again.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn", "role")
    return out.join(silent.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").unionByName(silent.where("role = 'system'").select("conv_id", "turn", F.col("role").alias("origin")))


@query("SELECT DISTINCT ON (doc_id) doc_id, sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 200)")
def hash_reimport(t):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.join(docs.where("doc_id < 200").select("digest"), "digest", "left_anti").select("doc_id", "digest")


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS transitions FROM events GROUP BY user_id) SELECT user_id, state, transitions FROM s
""")
def current_state(t):
    return t("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("state"), F.count("*").alias("transitions"))
