"""Names, mentions, components and document quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.entities import alias_index, gazetteer, quality_score, resolve, similar_names
from ..operators.relational import connected
from .registry import query

WORDS = ("idiot", "moron", "clown", "the apache license", "token")


def checkpointed(df):
    """Ends lineage in the shared folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its own; a cluster, whose machines share no local folder, an error."""
    import tempfile

    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


@query("""
WITH idx AS (SELECT DISTINCT c_custkey AS e, trim(lower(name)) AS key FROM (SELECT c_custkey, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'Customer of ' || c_nationkey FROM customer)),
n AS (SELECT key, count(*) AS n, min(e) AS only_one FROM idx GROUP BY key), m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'CUSTOMER OF ' || s_nationkey WHEN s_suppkey % 3 = 1 THEN replace(s_name, 'Supplier', 'customer') ELSE s_name END AS name FROM supplier)
SELECT id, name, CASE WHEN n = 1 THEN only_one END AS entity_id, CASE WHEN coalesce(n, 0) = 0 THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM m LEFT JOIN n ON trim(lower(m.name)) = n.key
""")
def alias_resolution(t):
    names = t("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    aliases = t("customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Customer of "), F.col("c_nationkey")).alias("name"))
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.concat(F.lit("CUSTOMER OF "), F.col("s_nationkey"))).when(k == 1, F.replace("s_name", F.lit("Supplier"), F.lit("customer"))).otherwise(F.col("s_name"))
    return resolve(t("supplier").select(F.col("s_suppkey").alias("id"), name.alias("name")), alias_index(names, aliases))


@query(r"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM n),
g AS (SELECT DISTINCT name, substr('  ' || word || ' ', i, 3) AS gram FROM (SELECT name, word, unnest(range(1, length(word) + 2)) AS i FROM w)), c AS (SELECT name, count(*) AS n FROM g GROUP BY name),
p AS (SELECT a.name, b.name AS other, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram GROUP BY 1, 2)
SELECT p.name, other, round(shared::DOUBLE / (c1.n + c2.n - shared), 6) AS similarity FROM p JOIN c c1 ON p.name = c1.name JOIN c c2 ON other = c2.name WHERE shared::DOUBLE / (c1.n + c2.n - shared) >= 0.5
""")
def trigram_match(t):
    names = t("part").select(F.col("p_name").alias("name"))
    return similar_names(names, names, 0.5).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS a, 100000000 + o_custkey AS b FROM orders), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT b, r.root FROM r JOIN both_ways ON r.node = both_ways.a)
SELECT node, min(root) AS root FROM r GROUP BY node
""")
def components_merge(t):
    """Orders hang together by their customer."""
    return connected(t("orders").select(F.col("o_orderkey").alias("a"), (100000000 + F.col("o_custkey")).alias("b")), checkpointed)


@query("SELECT doc_id, 'src' || (doc_id % 20) AS title, min(d2) AS target FROM documents LEFT JOIN (SELECT doc_id AS d2, source AS s2 FROM documents) ON s2 = 'src' || (doc_id % 20) GROUP BY 1, 2")
def wiki_links(t):
    text = F.concat(F.lit("see [[src"), F.col("doc_id") % 20, F.lit("|label]] and [[ ]]"))
    titles = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]*)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    links = t("documents").select("doc_id", F.explode(F.array_distinct(titles)).alias("title"))
    targets = t("documents").groupBy(F.col("source").alias("title")).agg(F.min("doc_id").alias("target"))
    return links.join(targets, "title", "left").select("doc_id", "title", "target")


@query(" UNION ALL ".join(f"SELECT doc_id AS id, '{w}' AS name, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9_äöüßàâçéèêëîïôùûñáíúóæœªº]', '  ', 'g') || ' ', ' {w.replace(' ', '  ')} ')) AS hits FROM documents WHERE hits > 0" for w in WORDS))
def gazetteer_hits(t):
    return gazetteer(t("documents").select(F.col("doc_id").alias("id"), "text"), list(WORDS))


@query("SELECT conv_id, turn, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9_äöüßàâçéèêëîïôùûñáíúóæœªº]', '  ', 'g') || ' ', ' the '))::BIGINT AS mentions FROM conversations")
def local_mentions(t):
    n = F.regexp_count(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])the(?![\p{L}\p{N}_])"))
    return t("conversations").select("conv_id", "turn", n.cast("long").alias("mentions"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS sentence FROM documents)
SELECT doc_id, count(*) AS sentences FROM s WHERE regexp_matches(lower(sentence), 'apache|token') AND regexp_matches(lower(sentence), 'licensed|under|=') GROUP BY doc_id
""")
def known_sources(t):
    s = t("documents").select("doc_id", F.explode(F.split("text", r"[.!?]\s+")).alias("sentence"))
    low = F.lower("sentence")
    return s.where(low.rlike("apache|token") & low.rlike("licensed|under|=")).groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query("""
WITH m AS (SELECT doc_id, n_chars, length(text) - length(replace(text, '!', '')) AS marks, coalesce(quality, 1) AS q, lang FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT *, least(marks, 15) + CASE WHEN lang = 'en' THEN 0 ELSE 10 END + least(20, round_even(least(marks, 100) / 100.0::DOUBLE * 50, 0)::INT) + CASE WHEN n_chars < 500 THEN 10 ELSE 0 END + CASE WHEN q = 0 THEN 5 ELSE 0 END AS lost FROM m)
SELECT doc_id, greatest(0, 100 - lost)::BIGINT AS score FROM p
""")
def quality_score_by_doc(t):
    joined = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    marks = F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))
    score = quality_score(marks, F.col("lang") == "en", F.least(marks, F.lit(100)) / 100.0, F.col("n_chars") < 500, F.coalesce("quality", F.lit(1)) == 0)
    return joined.select("doc_id", score.cast("long").alias("score"))


@query("""
SELECT s_nationkey, string_agg(DISTINCT CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'plain' END, ',' ORDER BY CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'plain' END) AS tags, count(*) AS mentions, min(s_name) AS label FROM supplier GROUP BY s_nationkey
""")
def merged_entities(t):
    tag = F.when(F.col("s_acctbal") > 5000, "rich").otherwise("plain")
    return t("supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"), F.count("*").alias("mentions"), F.min("s_name").alias("label"))
