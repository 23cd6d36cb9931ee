"""Counts, usage, cost and health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import daily, total_if_known
from .registry import query

TOKENS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def usage(t):
    """The usage log: one row a call, with tokens from the properties and whether the call succeeded."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", "ts", "user_id", "event_type", "value", tokens.alias("tokens"), (F.col("event_type") != "error").alias("success"))


money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'ALL', count(*) FROM documents")
def count_by_type_total(t):
    rolled = t("documents").rollup("lang").agg(F.count("*").alias("n"), F.grouping("lang").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("lang")).alias("lang"), "n")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, count(*) FILTER (text IS NULL OR length(text) < 200) AS short_turns, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id")
def conditional_counts(t):
    return t("conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("replies"),
        F.count_if(F.col("text").isNull() | (F.length("text") < 200)).alias("short_turns"),
        F.bool_or(F.col("role") == "system").alias("has_system"),
    )


@query("SELECT coalesce(source, '(none)') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def stats_by_source(t):
    return t("documents").groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH spine AS (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day)
SELECT day::VARCHAR AS day, count(event_id) AS n, coalesce(count(*) FILTER (event_type = 'error'), 0) AS errors FROM spine LEFT JOIN events ON ts::DATE = day GROUP BY day
""")
def daily_gapfill(t):
    return daily(t("events"), F.to_date("ts"), "2023-12-28", "2024-02-03", F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), zero=["n", "errors"]).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT count(*) AS calls, coalesce(sum({TOKENS}), 0)::BIGINT AS tokens, sum(value::DECIMAL(18,2))::DOUBLE AS amount, count(*) FILTER (value IS NULL) AS unknown_calls FROM events")
def usage_totals(t):
    return usage(t).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), money("value").cast("double").alias("amount"), F.count_if(F.col("value").isNull()).alias("unknown_calls"))


@query(f"SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS calls, sum({TOKENS})::BIGINT AS tokens, sum(value::DECIMAL(18,2))::DOUBLE AS amount FROM events GROUP BY 1, 2")
def usage_daily(t):
    return usage(t).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), money("value").cast("double").alias("amount"))


@query("SELECT event_type, count(*) AS calls, sum(value::DECIMAL(18,2))::DOUBLE AS amount, max(ts) AS last_call FROM events GROUP BY event_type")
def usage_ops(t):
    return usage(t).groupBy("event_type").agg(F.count("*").alias("calls"), money("value").cast("double").alias("amount"), F.max("ts").alias("last_call"))


@query("SELECT user_id, min(ts) AS first_call, count(*) AS calls, sum(value::DECIMAL(18,2))::DOUBLE AS amount FROM events GROUP BY user_id ORDER BY amount DESC NULLS LAST, user_id LIMIT 50")
def usage_docs(t):
    per = usage(t).groupBy("user_id").agg(F.min("ts").alias("first_call"), F.count("*").alias("calls"), money("value").cast("double").alias("amount"))
    return per.orderBy(F.desc_nulls_last("amount"), F.asc("user_id")).limit(50)


@query("SELECT ts::DATE::VARCHAR AS day, event_type = 'error' AS failed, count(*) AS n, (sum(value::DECIMAL(18,2)) * 100)::BIGINT // count(value) AS mean_cents FROM events GROUP BY 1, 2")
def latency_daily(t):
    cents = (money("value") * 100).cast("long").alias("cents")
    found = usage(t).groupBy(F.to_date("ts").cast("string").alias("day"), (~F.col("success")).alias("failed")).agg(F.count("*").alias("n"), cents, F.count("value").alias("known"))
    return found.select("day", "failed", "n", F.expr("cents div known").alias("mean_cents"))


@query(f"SELECT {TOKENS} AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def error_top(t):
    return usage(t).where("NOT success").groupBy(F.col("tokens").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("code")).limit(10)


@query("SELECT l.quality::BIGINT AS quality, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def feedback_nulls(t):
    joined = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, count(DISTINCT l_orderkey) AS documents, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, greatest(0, count(DISTINCT l_orderkey) - count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)) AS other FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def publisher_stats(t):
    # one row per (supplier, order) first, so that both distinct counts are plain sums
    per = t("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    sums = per.groupBy("l_suppkey").agg(F.count("*").alias("documents"), F.sum("r").alias("returned"))
    joined = t("supplier").join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("s_suppkey", n("documents").alias("documents"), n("returned").alias("returned"), F.greatest(F.lit(0), n("documents") - n("returned")).cast("long").alias("other"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1, 2")
def distinct_docs_by_source(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_suppkey").alias("sources"))


@query("SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(p_type, ' '))) AS tag FROM part) WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 30")
def tag_counts(t):
    tags = t("part").select(F.explode(F.split("p_type", " ")).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(30)


@query("""
SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS calls, sum(value::DECIMAL(18,2))::DOUBLE AS amount, floor(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / 60)::BIGINT AS minutes FROM events GROUP BY ROLLUP (event_type)
""")
def usage_rollup(t):
    rolled = usage(t).rollup("event_type").agg(F.count("*").alias("calls"), money("value").cast("double").alias("amount"), F.floor(F.sum("tokens") / 60).cast("long").alias("minutes"), F.grouping("event_type").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("event_type")).alias("event_type"), "calls", "amount", "minutes")


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type <> 'error') AS last_success, max_by(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_failure
FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT *, CASE WHEN successes = 0 AND failures = 0 THEN 'unknown' WHEN failures = 0 THEN 'ok' WHEN successes = 0 THEN 'down' ELSE 'warning' END AS status FROM s
""")
def service_health(t):
    recent = usage(t).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    s = recent.groupBy("user_id").agg(
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"),
        F.max(F.when(~F.col("success"), F.struct("ts", "event_id")))["event_id"].alias("last_failure"),
    )
    status = F.when((F.col("successes") == 0) & (F.col("failures") == 0), "unknown").when(F.col("failures") == 0, "ok").when(F.col("successes") == 0, "down").otherwise("warning")
    return s.withColumn("status", status)


@query("""
SELECT lang, CASE WHEN count(quality) = count(*) AND min(source) = max(source) THEN sum(quality)::BIGINT END AS known_total, CASE WHEN count(n_chars) = count(*) AND min(lang) = max(lang) THEN sum(n_chars)::BIGINT END AS chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def null_poison_sum(t):
    joined = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(total_if_known(F.col("quality"), F.col("source")).alias("known_total"), total_if_known(F.col("n_chars"), F.col("lang")).alias("chars"))


@query("SELECT r_name, coalesce(c_mktsegment, 'ALL') AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, c_mktsegment), (r_name))")
def grouping_sets(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = c.groupingSets([["r_name", "c_mktsegment"], ["r_name"]], "r_name", "c_mktsegment").agg(F.count("*").alias("n"))
    return rolled.select("r_name", F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), "n")


@query("""
SELECT page_id, length(html) AS html_size, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_size, CASE WHEN length(html) > 0 THEN round(100 - 100.0::DOUBLE * length(regexp_replace(html, '<[^>]*>', '', 'g')) / length(html), 2) END AS reduction FROM pages
""")
def size_reduction(t):
    p = t("pages").select("page_id", F.length("html").cast("long").alias("html_size"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_size"))
    return p.withColumn("reduction", F.when(F.col("html_size") > 0, F.round(100 - 100.0 * F.col("text_size") / F.col("html_size"), 2)))


@query("SELECT width_bucket AS bucket, n FROM (SELECT least(floor(n_chars / 1000), 20)::BIGINT AS width_bucket, count(*) AS n FROM documents GROUP BY 1)")
def length_histogram(t):
    return t("documents").groupBy(F.least(F.floor(F.col("n_chars") / 1000), F.lit(20)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
