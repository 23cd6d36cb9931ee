"""Excerpts, spans, posts and normalisations, over documents and documents of several shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import review as R
from .registry import query, shaped, shaped_sql


@query("""
WITH s AS (SELECT doc_id, text, right(text, 200) AS seg FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(seg, '. ') THEN substr(seg, instr(seg, '. ') + 2) WHEN contains(seg, '.' || chr(10)) THEN substr(seg, instr(seg, '.' || chr(10)) + 2)
  WHEN contains(seg, '? ') THEN substr(seg, instr(seg, '? ') + 2) WHEN contains(seg, '! ') THEN substr(seg, instr(seg, '! ') + 2) ELSE seg END AS tail, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || chr(10) || chr(10) || '[...tekst przycięty...]' END AS capped FROM s
""")
def excerpts(t):
    return t("documents").select("doc_id", R.sentence_tail(F.col("text"), 200).alias("tail"), R.capped(F.col("text"), 300).alias("capped"))


_HOSTS = [("https://www.facebook.com/x/posts/{}", "facebook"), ("https://facebook.com", "facebook"), ("https://pl.linkedin.com/in/y", "linkedin"), ("https://notfacebook.com/{}", None), ("https://facebook.com.example.org/", None), ("HTTPS://M.FACEBOOK.COM/a?b", "facebook"), ("no url {}", None), (None, None)]


@query(shaped_sql(_HOSTS, "url, platform"))
def url_platforms(t):
    return shaped(t, [r[:1] for r in _HOSTS], "url string").withColumn("platform", R.platform(F.col("url"))).drop("shape")


_POSTS = [
    ("A post {}\n\nof two parts\nLike\nComment", "A post {}\n\nof two parts"),
    ("A post {}\n12 reactions\nmore text", "A post {}"),
    ("Wpis {}\n3 komentarze\nx", "Wpis {}"),
    ("A post {}\n… more\nrest", "A post {}"),
    ("Count 1\n7\n\n12\nLike", "Count 1"),
    ("Only one number\n7\nstays", "Only one number\n7\nstays"),
    ("12345\n99999\nlong numbers stay", "12345\n99999\nlong numbers stay"),
    ("  nothing {} below  ", "nothing {} below"),
    ("Like", ""),
    ("", ""),
    (None, ""),
]


@query(shaped_sql(_POSTS, "post, text"))
def post_texts(t):
    return shaped(t, [r[:1] for r in _POSTS], "post string").withColumn("text", R.post_text(F.col("post"))).drop("shape")


_TOLD = [("Title {}\nWczoraj, 12:58\ntext", "2024-03-01"), ("3 godziny temu", "2024-03-01"), ("1 godzinę temu", "2024-03-02"), ("Dziś, 09:15", "2024-03-02"), ("x\n 200 minut temu ", "2024-03-01"), ("wczoraj byłem w {}", None), ("dzisiaj", "2024-03-02"), ("", None), (None, None)]


@query(shaped_sql(_TOLD, "text, day"))
def told_dates(t):
    return shaped(t, [r[:1] for r in _TOLD], "text string").withColumn("day", R.told_date(F.col("text"), F.lit("2024-03-02 02:00:00").cast("timestamp")).cast("string")).drop("shape")


_PERIODS = [
    ("  II  RP ", "1939", "1918", "HIGH", "II RP", 1918, 1939, "high"),
    ("Antyk {}", "-500", "400", "sure", "Antyk {}", -500, 400, "low"),
    ("PRL {}", "1944", None, None, "PRL {}", 1944, None, "low"),
    ("x" * 120, "9999", "abc", "medium", "x" * 100, None, None, "medium"),
    ("  ", "1", "2", "low", None, None, None, None),
    (None, "1", "2", "low", None, None, None, None),
]


@query(shaped_sql(_PERIODS, "name, first, last, sure, label, start, \"end\", confidence"))
def named_periods(t):
    rows = shaped(t, [r[:4] for r in _PERIODS], "name string, first string, last string, sure string")
    return rows.withColumn("p", R.period(F.col("name"), F.col("first"), F.col("last"), F.col("sure"))).select("doc_id", "name", "first", "last", "sure", "p.label", "p.start", "p.end", "p.confidence")


@query("SELECT o_orderkey, least(o_custkey, o_orderkey) AS start, CASE WHEN o_orderkey % 5 > 0 THEN greatest(o_custkey, o_orderkey) END AS \"end\", o_orderkey % 5 > 0 AND o_custkey > o_orderkey AS swapped FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, o_custkey, NULL, false FROM orders WHERE o_orderkey % 5 = 0")
def range_order(t):
    end = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey"))
    return t("orders").select("o_orderkey", R.ordered(F.col("o_custkey"), end).alias("r")).select("o_orderkey", "r.*")


_FRAGMENTS = [
    ("one\n\ntwo", 0, "one\n\ntwo"),
    ("aaaaa\n\nbbbbb\n \ncc", 0, "aaaaa"),
    ("aaaaa\n\nbbbbb\n \ncc", 1, "bbbbb\n\ncc"),
    ("x\n\nabcdefghijklmnop\n\ny", 0, "x"),
    ("x\n\nabcdefghijklmnop\n\ny", 1, "abcdefghij"),
    ("x\n\nabcdefghijklmnop\n\ny", 2, "klmnop"),
    ("x\n\nabcdefghijklmnop\n\ny", 3, "y"),
    ("\n\n abcde \n\n\n\nfgh\n\n", 0, "abcde\n\nfgh"),
    ("1234567890", 0, "1234567890"),
]


_FRAGMENT_TEXTS = list(dict.fromkeys(r[0] for r in _FRAGMENTS))


@query(shaped_sql([(_FRAGMENT_TEXTS.index(r[0]), *r) for r in _FRAGMENTS], "text, position, fragment", len(_FRAGMENT_TEXTS)))
def timeline_fragments(t):
    rows = shaped(t, [(x,) for x in _FRAGMENT_TEXTS], "text string")
    return rows.select("doc_id", "text", F.posexplode(R.fragments(F.col("text"), 10)).alias("position", "fragment"))


_SPANS = [
    ("The quick\n  brown fox {}", "quick brown", 4, 17, False, False, "The  fox {}"),
    ("The quick brown fox {}", "ick  bro", 6, 13, True, True, "The quwn fox {}"),
    ("a.b a+b", "a+b", 4, 7, False, False, "a.b "),
    ("twice twice", " twice ", 0, 5, False, False, " twice"),
    ("końcówka", "ńców", 2, 6, True, True, "koka"),
    ("nothing {}", "else", None, None, None, None, "nothing {}"),
    ("nothing {}", "  ", None, None, None, None, "nothing {}"),
    ("q\\Ed", "\\E", 1, 3, False, True, "qd"),
]


@query(shaped_sql(_SPANS, "original, wanted, start, \"end\", mid_start, mid_end, rest"))
def span_cuts(t):
    rows = shaped(t, [r[:2] for r in _SPANS], "original string, wanted string")
    s = R.span(F.col("original"), F.col("wanted"))
    return rows.withColumn("s", s).select("doc_id", "original", "wanted", "s.start", "s.end", "s.mid_start", "s.mid_end", R.without_span(F.col("original"), F.col("wanted")).alias("rest"))


_LABELS = [("Al-Faszir", "El Fasher, Sudan {}, Sudan", "Al-Faszir, Sudan {}, Sudan"), ("Kijów {}", "Kyiv", "Kijów {}"), ("A", "B,", "A"), ("A", None, "A"), ("A", "", "A")]


@query(shaped_sql(_LABELS, "query, display, label"))
def place_labels(t):
    return shaped(t, [r[:2] for r in _LABELS], "query string, display string").withColumn("label", R.relabelled(F.col("query"), F.col("display"))).drop("shape")


_KEYS = [("uploads/2024/abc123-report-{}.pdf", "report-{}.pdf"), ("{}.txt", "{}.txt"), ("a-b/c.txt", "c.txt"), ("x/-y", "y"), ("x-", "")]


@query(shaped_sql(_KEYS, "key, name"))
def upload_names(t):
    return shaped(t, [r[:1] for r in _KEYS], "key string").withColumn("name", R.upload_name(F.col("key"))).drop("shape")


@query("SELECT event_id, round(ceil(user_id / 60.0::DOUBLE) * 0.37::DOUBLE, 2) AS price FROM events")
def audio_prices(t):
    return t("events").select("event_id", R.audio_price(F.col("user_id"), 0.37).alias("price"))


@query(r"SELECT doc_id, doc_id % 3 + 1 > 1 AND length(text) <= 10000 AND len(regexp_extract_all(text, '\S+')) <= 1000 AS compact FROM documents")
def compact_chapters(t):
    return t("documents").select("doc_id", R.is_compact(F.col("text"), F.col("doc_id") % 3 + 1).alias("compact"))
