"""Articles, transcripts and model answers, over texts built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as A
from ..functions import transcripts as R
from .registry import query, shaped, shaped_sql


def _page():
    k = F.col("page_id") % 4
    name = F.concat(F.lit('"Jan '), F.col("page_id"), F.lit('"'))
    author = F.when(k == 0, name).when(k == 1, F.concat(F.lit('{"@type":"Person","name":'), name, F.lit("}"))).when(k == 2, F.concat(F.lit("["), name, F.lit(',{"name":"Ewa"}]'))).otherwise(F.lit('{"@id":"#p"}'))
    block = F.concat(F.lit('{"@graph":[{"@type":"NewsArticle","datePublished":"2024-03-0'), (k + 1).cast("string"), F.lit('T10:00:00Z","author":'), author, F.lit('},{"@id":"#p","name":'), name, F.lit("}]}"))
    return F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit('</script><script type="application/ld+json">{broken</script><meta name="date" content="1999-01-01"></html>'))


@query("SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'Jan ' || page_id || '|Ewa' ELSE 'Jan ' || page_id END AS authors, '2024-03-0' || (page_id % 4 + 1) AS published FROM pages")
def article_facts(t):
    html = _page()
    return t("pages").select("page_id", F.array_join(A.article_authors(html), "|").alias("authors"), A.publication_date(html).cast("string").alias("published"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS target FROM pages")
def redirect_targets(t):
    token = F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://click.example.com/c/"), token, F.lit("?x=1"))).otherwise(F.lit("https://click.example.com/c/plain"))
    return t("pages").select("page_id", A.embedded_target(link).alias("target"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def model_answers(t):
    answer = F.concat(F.lit("Sure:\n```json\n["), F.col("props"), F.lit(', {"k": 1\n```'))
    return t("events").select("event_id", F.explode(F.from_json(A.complete_objects(answer), "array<struct<k:bigint>>")).alias("o")).select("event_id", "o.k")


_TIMED = [
    ("0:00 - intro\n\nbody {} 1:30\n1:00:05 end", [(0, 90, "intro"), (90, 3605, "body {}"), (3605, R.OPEN_END, "end")]),
    ("no times\nat all", []),
    ("{} 0:10", [(10, R.OPEN_END, "{}")]),
    ("1:00 A\n1:00 B", [(60, 60, "A"), (60, R.OPEN_END, "B")]),
    ("02:05 | {}", [(125, R.OPEN_END, "{}")]),
    (None, []),
    ("9:99 odd", [(639, R.OPEN_END, "odd")]),
    ("12:00:00 – late {}\nx", [(43200, R.OPEN_END, "late {}")]),
    ("  x 1:02:03  ", [(3723, R.OPEN_END, "x")]),
    ("123:00 no", []),
    ("", []),
]


@query(shaped_sql([(k, *c) for k, (_, found) in enumerate(_TIMED) for c in found], 'start, "end", title', len(_TIMED)))
def transcript_chapters(t):
    rows = shaped(t, [r[:1] for r in _TIMED], "lines string")
    return rows.select("doc_id", F.explode(R.chapter_list(F.col("lines"))).alias("c")).select("doc_id", "c.start", "c.end", "c.title")


_HEARD = [
    ('[{"text":"before","start":1.0},{"text":" one {} ","start":61.0},{"text":"two","start":130.5},{"text":"late","start":70}]', "before\n## A\none {}\n## B\ntwo\nlate"),
    ('[{"text":"{}","start":200}]', "## B\n{}"),
    ("[]", ""),
    ('[{"text":" a {} ","start":59.9},{"text":"b","start":60}]', "a {}\n## A\nb"),
    ('[{"text":"x","start":500},{"text":"y","start":60},{"text":"{}","start":130}]', "## B\nx\ny\n{}"),
    ("no json", None),
    ('[{"text":"t","start":120}]', "## B\nt"),
    ('[{"text":"t {}","start":119.5},{"text":"u","start":120.5}]', "## A\nt {}\n## B\nu"),
    ('[{"text":"","start":0}]', ""),
    ('[{"text":"\\u0142 {}","start":0}]', "ł {}"),
]


@query("SELECT *, CASE WHEN doc_id % 200 < 60 THEN '' WHEN doc_id % 200 < 120 THEN 'A' ELSE 'B' END || CASE WHEN doc_id % 200 < 60 AND doc_id % 200 + 55 > 60 THEN 'A' WHEN doc_id % 200 >= 60 AND doc_id % 200 < 120 AND doc_id % 200 + 55 > 120 THEN '|B' ELSE '' END AS within FROM (" + shaped_sql([r[1:] for r in _HEARD], "text") + ")")
def transcript_text(t):
    """Ten shapes of transcripts over two chapters, and the chapters of a chunk of 55 seconds from any second."""
    rows = shaped(t, [r[:1] for r in _HEARD], "raw string")
    chapters = R.chapter_list(F.lit("1:00 A\n2:00 B"))
    begin = F.col("doc_id") % 200
    return rows.select("doc_id", R.with_chapters(F.col("raw"), chapters).alias("text"), F.array_join(R.chapters_within(begin, begin + 55, chapters), "|").alias("within"))


_LABELLED = [
    ("TYPE: temat\nTOPIC: {}\nTEXT:\nabc\n", "TEMAT", "{}", "abc"),
    ("TOPIC: a {}\nTYPE: x\nTEXT: y\nz", "X", "a {}", "y\nz"),
    ("TEXT: only {}", "", "", "only {}"),
    ("nothing {}", "", "", ""),
    ("TYPE: A\nTYPE: B\nTOPIC:\nTEXT:\n\n  multi\n\n lines {}  ", "A", "", "multi\n\n lines {}"),
    ("", "", "", ""),
    (None, None, None, None),
    ("x TYPE: no\nTEXT: {}", "", "", "{}"),
    ("TYPE: reklama", "REKLAMA", "", ""),
    ("TEXT: a\nTOPIC: late {}", "", "late {}", "a"),
]


@query(shaped_sql([r[1:] for r in _LABELLED], "type, topic, text"))
def labelled_output(t):
    return shaped(t, [r[:1] for r in _LABELLED], "raw string").select("doc_id", R.topics(F.col("raw")).alias("t")).select("doc_id", "t.*")
