"""Text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query

FOLD_SQL = f"trim(regexp_replace(lower(translate(%s, '{T.MARKED}', '{T.PLAIN}')), '\\s+', ' ', 'g'))"


@query("SELECT doc_id, sha256(text) AS digest, sha256(concat_ws('|', lang, source, text)) AS input_digest FROM documents")
def sha_ids(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat_ws("|", "lang", "source", "text"), 256).alias("input_digest"))


@query(r"""
SELECT doc_id, length(regexp_replace(text, '(?s)^(.*)(?:the ).*$', '\1')) AS before_last, length(CASE WHEN regexp_matches(text, '(?s)the ') THEN trim(regexp_replace(text, '(?s)^.*?(?:the )', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END) AS after_first,
length(CASE WHEN regexp_extract(text, '(?s)^(.*?(?:the ))', 1) <> '' THEN trim(regexp_extract(text, '(?s)^(.*?(?:the ))', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END) AS through_first, length(regexp_replace(text, '[0-9]+', '', 'g')) AS no_digits FROM documents
""")
def regex_cut(t):
    c = F.col("text")
    n = lambda x: F.length(x).cast("long")
    return t("documents").select("doc_id", n(T.cut_from_last(c, "the ")).alias("before_last"), n(T.after_first(c, "the ")).alias("after_first"), n(T.through_first(c, "the ")).alias("through_first"), n(F.regexp_replace(c, "[0-9]+", "")).alias("no_digits"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '!!|[|]|Licensed')), chr(10))) AS digest FROM documents")
def line_filter(t):
    return t("documents").select("doc_id", F.sha2(T.without_lines(F.col("text"), r"!!|[|]|Licensed"), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({FOLD_SQL % 'text'}) AS digest FROM documents")
def fold_text(t):
    return t("documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("digest"))


@query(rf"SELECT doc_id, regexp_replace(trim(regexp_replace(lower(translate(text, '{T.MARKED}', '{T.PLAIN}')), '[^a-z0-9 -]', '', 'g')), '[\s-]+', '-', 'g') AS slug FROM documents")
def slug(t):
    return t("documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("""
WITH c AS (SELECT c_custkey, 'Jan Nowak, ' || c_name || '; Redakcja / jan nowak i ' || c_mktsegment AS byline FROM customer), p AS (SELECT c_custkey, list_filter(list_transform(regexp_split_to_array(byline, '[,;/]| i '), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'redakcja') AS names FROM c)
SELECT c_custkey, array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i), '|') AS names FROM p
""")
def split_names(t):
    byline = F.concat(F.lit("Jan Nowak, "), F.col("c_name"), F.lit("; Redakcja / jan nowak i "), F.col("c_mktsegment"))
    return t("customer").select("c_custkey", F.array_join(T.author_names(byline), "|").alias("names"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 40) || chr(10) || '...' || chr(10) || right(text, 40) END AS excerpt FROM conversations")
def head_tail(t):
    return t("conversations").select("conv_id", "turn", T.head_tail(F.col("text"), 40).alias("excerpt"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?s).{0,20}token.{0,20}'))::BIGINT AS n, array_to_string(regexp_extract_all(text, '(?s).{0,20}token.{0,20}'), '|') AS snippets FROM documents WHERE contains(text, 'token')")
def snippets(t):
    s = T.snippets(F.col("text"), "token", 20)
    return t("documents").where(F.contains("text", F.lit("token"))).select("doc_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("snippets"))


@query("SELECT p_partkey, p_brand || ' ' || p_name AS text FROM part")
def fillers(t):
    noisy = F.concat(F.col("p_brand"), F.lit(" eee, "), F.lit("um "), F.col("p_name"))
    return t("part").select("p_partkey", T.without_fillers(noisy).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'A: ' || role || chr(10) || 'B: yes' ELSE 'B: ' || role || chr(10) || 'A: no' END AS said FROM conversations")
def speaker_turns(t):
    even, odd = F.concat("role", F.lit(" >> yes")), F.concat(F.lit(" >> "), "role", F.lit(" >> no"))
    return t("conversations").select("conv_id", "turn", T.speakers(F.when(F.col("turn") % 2 == 0, even).otherwise(odd), "A", "B").alias("said"))


@query("SELECT p_partkey, p_size % 3 = 0 AS bait FROM part")
def clickbait_flag(t):
    title = F.concat(F.when(F.col("p_size") % 3 == 0, "Nie uwierzysz: ").otherwise("Raport: "), F.col("p_name"))
    return t("part").select("p_partkey", T.is_clickbait(title).alias("bait"))


@query("SELECT page_id, page_id % 3 AS captions FROM pages")
def caption_count(t):
    lines = F.concat(F.lit("Body of the text\n"), F.when(F.col("page_id") % 3 > 0, "Fot. A. Nowak\n").otherwise(""), F.when(F.col("page_id") % 3 > 1, "Widok miasta PAP\n").otherwise(""), F.lit("end"))
    return t("pages").select("page_id", F.size(F.filter(F.split(lines, "\n"), T.is_caption)).cast("long").alias("captions"))


@query("SELECT doc_id, string_split(coalesce(lang, '') || '-XX', '-')[1] = 'en' AS english, length(coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), text)) AS best_length FROM documents")
def language_compare(t):
    best = T.best_text(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("text"))
    return t("documents").select("doc_id", (F.split_part(F.concat(F.coalesce("lang", F.lit("")), F.lit("-XX")), F.lit("-"), F.lit(1)) == "en").alias("english"), F.length(best).cast("long").alias("best_length"))


@query("SELECT p_partkey, array_to_string(list_distinct(string_split(lower(p_name), ' '))[1:0], '') || p_name AS terms FROM part")
def search_term_list(t):
    raw = F.concat(F.lit("- "), F.col("p_name"), F.lit("\n1. "), F.upper("p_name"), F.lit("\n"))
    return t("part").select("p_partkey", F.array_join(T.search_terms(raw), "|").alias("terms"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'version 2.0')")
def grounded_quotes(t):
    return t("documents").where(T.grounded(F.lit("Version  2.0"), F.col("text"))).select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'big,new' ELSE 'new' END AS tags FROM part")
def rewrite_tags(t):
    known = F.create_map(F.lit("large"), F.lit("big"), F.lit("fresh"), F.lit("new"))
    tags = F.when(F.col("p_size") > 20, "large,fresh,big,new").otherwise("fresh,new")
    return t("part").select("p_partkey", F.array_join(F.array_distinct(F.transform(F.split(tags, ","), lambda x: F.coalesce(F.element_at(known, x), x))), ",").alias("tags"))
