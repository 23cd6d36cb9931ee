"""Steps of documents, versions and exports of notes, mail parts, paragraphs, places near lines, group memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, markup, transcripts
from ..functions.review import author_biography
from ..operators import geometry, mail, paragraphs
from ..operators import workflow as W
from ..operators.filters import SearchFilters, apply_filters
from ..sources import notes
from ..streaming import steps
from .registry import query, shaped, shaped_sql

CHAIN = steps.Chain(("fetch", "clean", "transcribe", "embed"), attempts=2)


@query("""
WITH RECURSIVE e AS (SELECT o_custkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'ensure' END AS event, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
s(doc, k, step, status, attempt) AS (SELECT DISTINCT doc, 0::BIGINT, 0, 'waiting', 0 FROM e UNION ALL
  SELECT s.doc, e.k, CASE WHEN status = 'waiting' AND event = 'done' AND step < 3 THEN step + 1 ELSE step END,
    CASE WHEN event = 'ensure' AND status = 'failed' THEN 'waiting' WHEN status <> 'waiting' THEN status WHEN event = 'done' AND step = 3 THEN 'finished' WHEN event = 'failed' AND attempt = 1 THEN 'failed' ELSE status END,
    CASE WHEN event = 'ensure' AND status = 'failed' THEN 0 WHEN status <> 'waiting' OR event = 'ensure' THEN attempt WHEN event = 'done' AND step < 3 THEN 0 ELSE attempt + 1 END
  FROM s JOIN e ON s.doc = e.doc AND e.k = s.k + 1)
SELECT doc, step, status, attempt, (['fetch', 'clean', 'transcribe', 'embed'])[step + 1] AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k DESC) AS r FROM s) WHERE r = 1
""")
def step_states(t):
    """Orders as the events of their customers' documents: filled ones end a step, open ones fail it, the others revive."""
    kind = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("ensure")
    o = t("orders").select(F.col("o_custkey").alias("doc"), kind.alias("event"), F.lit(1).alias("turn"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("n"))
    first = o.select("doc").distinct().select("doc", F.lit("ensure").alias("event"), F.lit(0).alias("turn"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).cast("long").alias("n"))
    return steps.states(o.unionByName(first), CHAIN, "doc", ["turn", "at", "n"])


@query("""
WITH v AS (SELECT 'notes/' || user_id % 50 || '.md' AS path, event_id AS version, event_type || ' ' || value AS content_after FROM events),
b AS (SELECT *, lag(content_after) OVER (PARTITION BY path ORDER BY version) AS content_before, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS r FROM v)
SELECT path, version, content_before, content_after, r = 1 AS current FROM b
""")
def note_versions(t):
    v = t("events").select(F.concat(F.lit("notes/"), F.col("user_id") % 50, F.lit(".md")).alias("path"), F.col("event_id").alias("version"), F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("content_after"))
    now = notes.notes_at(v).select("path", "version", F.lit(True).alias("is_last"))
    return notes.with_before(v).join(now, ["path", "version"], "left").select("path", "version", "content_before", "content_after", F.col("is_last").isNotNull().alias("current"))


@query("""
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'a/b' WHEN 1 THEN '../x' WHEN 2 THEN 'a/../../x' WHEN 3 THEN '/etc' WHEN 4 THEN '' WHEN 5 THEN 'a/../b' WHEN 6 THEN './a' WHEN 7 THEN 'a/..' WHEN 8 THEN 'a\\b' ELSE NULL END || CASE WHEN doc_id % 10 IN (0, 5, 6) THEN '/' || source ELSE '' END AS path, doc_id % 10 IN (0, 5, 6) AS inside FROM documents
""")
def note_paths(t):
    shapes = F.array(*map(F.lit, ["a/b", "../x", "a/../../x", "/etc", "", "a/../b", "./a", "a/..", "a\\b", None]))
    k = F.col("doc_id") % 10
    path = F.concat(F.element_at(shapes, (k + 1).cast("int")), F.when(k.isin(0, 5, 6), F.concat(F.lit("/"), "source")).otherwise(""))
    return t("documents").select("doc_id", path.alias("path"), notes.inside(path).alias("inside"))


_B64 = "replace(translate(to_base64(encode({})), '+/', '-_'), '=', '')"
_PART = "'{{\"mimeType\":\"{}\",\"body\":{{\"data\":\"' || {} || '\"}}}}'"


@query("""
SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN '[]' WHEN 1 THEN '[1]' WHEN 2 THEN '[0, 1, 0]' WHEN 3 THEN '[0, 0]' WHEN 6 THEN '[1, 0, 0, 0]' END AS place, CASE doc_id % 8 WHEN 6 THEN 'żółć ' || source ELSE text END AS text
FROM documents WHERE doc_id % 8 IN (0, 1, 2, 3, 6) AND (doc_id % 8 = 6 OR text <> '')
""")
def mail_parts(t):
    """The text of each document in a message of eight shapes: flat, after another type, three deep, before and after others, none, broken, empty first, four deep."""
    code = lambda c: F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_")
    own, other = code(F.coalesce("text", F.lit(""))), code(F.concat(F.lit("żółć "), "source"))
    part = lambda mime, data, *parts: F.concat(F.lit(f'{{"mimeType":"{mime}","body":{{"data":"'), data, F.lit('"},"parts":['), *[x for k, p in enumerate(parts) for x in ([F.lit(",")] if k else []) + [p]], F.lit("]}"))
    none, html, plain = F.lit(""), "text/html", "text/plain"
    shapes = [
        part(plain, own),
        part("multipart/mixed", none, part(html, other), part(plain, own)),
        part("multipart/mixed", none, part("multipart/related", none, part(html, other), part("multipart/alternative", none, part(plain, own), part(plain, other)))),
        part("multipart/mixed", none, part("multipart/alternative", none, part(plain, own), part(html, other)), part(plain, other)),
        part("multipart/mixed", none, part(html, own)),
        F.lit('{"mimeType": "text/plain", "body"'),
        part("multipart/mixed", none, part(plain, none), part("a/b", none, part("a/b", none, part("a/b", none, part(plain, other))))),
        F.lit(None).cast("string"),
    ]
    k, payload = F.col("doc_id") % len(shapes), F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        payload = F.when(k == n, shape).otherwise(payload)
    out = mail.body_parts(t("documents").select(F.col("doc_id").alias("id"), payload.alias("payload")), "text/plain")
    return out.select("id", F.concat(F.lit("["), F.array_join("place", ", "), F.lit("]")).alias("place"), "text")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?…]+(?:\s|$)|$)'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '') AS ss FROM documents)
SELECT doc_id, CASE WHEN len(ss) = 0 THEN 0 ELSE 1 + len(list_filter(range(1, len(ss)), lambda i: length(regexp_replace(ss[i], '\s', '', 'g')) % 5 = 0)) END AS n_paragraphs FROM s
""")
def paragraph_votes(t):
    """The same borders from windows of any size: a border is proposed where a sentence's length divides by five, by windows that hold it; a window's last sentence is proposed always, and never counts."""
    divides = lambda s: F.length(F.regexp_replace(s["sentence"], r"\s", "")) % 5 == 0

    def propose(windows):
        last = F.element_at("sentences", -1)["at"]
        return windows.select("key", "window", F.explode(F.filter("sentences", lambda s: divides(s) | (s["at"] == last))).alias("s")).select("key", "window", F.col("s.at").alias("after"))

    wide = paragraphs.paragraphs(t("documents"), propose, 12, 6)
    return wide.select("doc_id", "n_paragraphs")


_POINT = "{{'lat': ({k} * 7919 % 1400) / 10.0::DOUBLE - 70, 'lon': ({k} * 104729 % 3400) / 10.0::DOUBLE - 170}}"


@query(f"""
WITH p AS (SELECT c_custkey AS id, {_POINT.format(k='c_custkey')} AS p FROM customer),
l AS (SELECT n_nationkey AS line, [{_POINT.format(k='n_nationkey')}, {_POINT.format(k='(n_nationkey + 7)')}, {_POINT.format(k='(n_nationkey * 3 + 1)')}] AS ps FROM nation),
s AS (SELECT line, ps[n] AS a, ps[n + 1] AS b FROM (SELECT *, unnest([1, 2]) AS n FROM l)),
d AS (SELECT id, line, (a.lon - p.lon) * cos(radians(p.lat)) AS ax, a.lat - p.lat AS ay, (b.lon - p.lon) * cos(radians(p.lat)) AS bx, b.lat - p.lat AS byy FROM p, s),
e AS (SELECT *, CASE WHEN (bx - ax) * (bx - ax) + (byy - ay) * (byy - ay) > 0 THEN least(1, greatest(0, -(ax * (bx - ax) + ay * (byy - ay)) / ((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)))) ELSE 0 END AS at0 FROM d),
f AS (SELECT id, line, sqrt((ax + at0 * (bx - ax)) * (ax + at0 * (bx - ax)) + (ay + at0 * (byy - ay)) * (ay + at0 * (byy - ay))) * 111.195::DOUBLE AS km FROM e)
SELECT id, line, round(min(km), 6) AS km FROM f WHERE km <= 150 GROUP BY id, line
""")
def places_near_lines(t):
    """Customers as places, nations as lines of three points."""
    at = lambda k: geometry.point(k * 7919 % 1400 / 10.0 - 70, k * 104729 % 3400 / 10.0 - 170)
    n = F.col("n_nationkey").cast("long")
    lines = t("nation").select(F.col("n_nationkey").alias("line"), F.array(at(n), at(n + 7), at(n * 3 + 1)).alias("points"))
    out = geometry.near_lines(t("customer").select(F.col("c_custkey").alias("id"), at(F.col("c_custkey")).alias("point")), lines, 150)
    return out.select("id", "line", F.round("km", 6).alias("km"))


@query("""
WITH e AS (SELECT o_custkey AS doc, n_name AS name, count(*) AS mentions FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT 'found' AS kind, doc, name, n_regionkey AS line FROM e JOIN nation ON n_name = name WHERE mentions >= 2 AND n_nationkey % 3 = 1 AND n_nationkey % 4 = 0
UNION ALL SELECT DISTINCT 'wanted', NULL, name, NULL FROM e JOIN nation ON n_name = name WHERE mentions >= 2 AND n_nationkey % 3 = 1 AND n_nationkey % 4 > 1
""")
def lines_attached(t):
    """Nations as places: one of three is rejected by the geocoder, one unchecked; of four, one is cached as a line and one as a miss."""
    n = t("nation")
    e = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("o_custkey").alias("doc"), F.col("n_name").alias("name")).agg(F.count("*").alias("mentions"))
    geocodes = n.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 2).alias("resolved"))
    cache = n.where("n_nationkey % 4 < 2").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 == 0).alias("resolved"), F.col("n_regionkey").alias("line"))
    found, wanted = geometry.lines_by_name(e, geocodes, cache)
    return found.select(F.lit("found").alias("kind"), "doc", "name", "line").unionByName(wanted.select(F.lit("wanted").alias("kind"), F.lit(None).cast("long").alias("doc"), "name", F.lit(None).cast("int").alias("line")))


@query("""
WITH g AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'topic' ELSE 'priority' END AS kind, n_regionkey AS rank FROM nation WHERE n_nationkey % 5 > 0),
given AS (SELECT DISTINCT o_custkey AS d, g.* FROM orders JOIN g ON g.id = (o_orderkey + o_custkey) % 25),
cur AS (SELECT c_custkey AS d, c_nationkey AS id FROM customer WHERE c_custkey % 3 = 0),
best AS (SELECT d, min({'rank': rank, 'id': id})['id'] AS id FROM given WHERE kind = 'priority' AND d NOT IN (SELECT d FROM cur WHERE id % 2 = 1) GROUP BY d)
SELECT d AS document_id, id AS group_id, 'feed_import' AS source FROM (SELECT d, id FROM given WHERE kind = 'topic' UNION ALL SELECT d, id FROM best) WHERE (d, id) NOT IN (SELECT (d, id) FROM cur)
""")
def groups_copied(t):
    """Orders as feed items of their customers' documents, nations as groups, one in five archived."""
    n = F.col("n_nationkey")
    groups = t("nation").select(n.alias("group_id"), F.when(n % 2 == 0, "topic").otherwise("priority").alias("kind"), F.col("n_regionkey").alias("rank"), (n % 5 == 0).alias("archived"))
    o = t("orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("document_id"))
    members = o.select(F.col("o_orderkey").alias("item_id"), ((F.col("o_orderkey") + F.col("o_custkey")) % 25).cast("int").alias("group_id"))
    current = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("group_id"))
    return W.copied_groups(items, members, groups, current, "feed_import")


@query("""
SELECT page_id AS item_id, CASE WHEN d IS NOT NULL THEN d WHEN page_id % 4 = 0 THEN -1 END AS document_id, CASE WHEN d IS NOT NULL AND page_id % 3 < 2 THEN 'imported' ELSE (['new', 'error', 'ignored'])[page_id % 3 + 1] END AS status
FROM pages LEFT JOIN (SELECT url AS u, min(page_id) AS d FROM pages WHERE page_id % 2 = 0 GROUP BY url) ON u = url
""")
def items_linked(t):
    p, k = t("pages"), F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, ["new", "error", "ignored"])), (k % 3 + 1).cast("int"))
    items = p.select(k.alias("item_id"), "url", F.when(k % 4 == 0, -1).cast("long").alias("document_id"), status.alias("status"))
    return W.linked_items(items, p.where("page_id % 2 = 0").select(k.alias("document_id"), "url")).drop("url")


_BODY = "Pierwszy akapit artykułu {} o niczym. " * 6
_LIVES = [
    (f"{_BODY.strip()}\n\nJan Kowalski jest dziennikarzem od wielu lat, a wcześniej zajmował się czymś zupełnie innym niż teraz.", "Jan Kowalski", _BODY.strip(), "Jan Kowalski jest dziennikarzem od wielu lat, a wcześniej zajmował się czymś zupełnie innym niż teraz."),
    (f"{_BODY.strip()}\n\nJAN KOWALSKI, {{}}\n \nPracuje w redakcji.\n\nWięcej", "Jan Kowalski", _BODY.strip(), "JAN KOWALSKI, {}\n \nPracuje w redakcji.\n\nWięcej"),
    (f"Jan Kowalski jest autorem.\n\n{_BODY.strip()}", "Jan Kowalski", None, None),
    (f"{_BODY.strip()}\n\nJan Kowalski\n\nKoniec", "Jan Kowalski", None, None),
    (f"{_BODY.strip()}\n\nKowalski jest autorem", "Kowalski", None, None),
    (f"{_BODY.strip()}\n\nNikt nie jest autorem", "Jan Kowalski", None, None),
    (f"{_BODY.strip()}\n\n{'Za daleko, więc na pewno nie jest to notka o autorze, choć na samym końcu wspomina go tutaj '}Jan Kowalski", "Jan Kowalski", None, None),
    (f"{_BODY.strip()}\n\nAnna Żuk\n\n\nBiogram {{}}\n\n a\n\nb\n\nbyła tu", "anna żuk", _BODY.strip(), "Anna Żuk\n\n\nBiogram {}\n\n a\n\nb\n\nbyła tu"),
    ("", "Jan Kowalski", None, None),
    ("Tekst {}", None, None, None),
]


@query(shaped_sql([(r[2] or r[0], r[3]) for r in _LIVES], "body, biography"))
def author_biographies(t):
    return shaped(t, [r[:2] for r in _LIVES], "text string, author string").withColumn("b", author_biography(F.col("text"), F.col("author"))).select("doc_id", "b.*")


def _library(t) -> tuple:
    """Orders as documents with a publisher, a source and a collection; several nations have one name as publishers."""
    o, n = F.col("o_orderkey"), F.col("n_nationkey")
    docs = t("orders").select(o.alias("id"), (o % 25).cast("int").alias("publisher_id"), (o % 7).cast("int").alias("discovery_source_id"), (o % 5).cast("int").alias("collection_id"), F.col("o_orderpriority").alias("document_type"))
    return docs, {
        "publishers": t("nation").select(n.alias("id"), F.concat(F.lit("Wydawnictwo  ŁÓDŹ "), "n_regionkey").alias("name")),
        "publisher_domains": t("nation").select(n.alias("publisher_id"), F.concat(F.lit("N"), n % 12, F.lit(".Example.com")).alias("domain")),
        "discovery_sources": t("nation").where("n_nationkey < 7").select(n.alias("id"), F.concat(F.lit("Źródło "), n % 3).alias("name")),
        "collections": t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
    }


@query("SELECT o_orderkey AS id FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE n_regionkey = 2")
def filter_publisher_name(t):
    docs, lookups = _library(t)
    return apply_filters(docs, SearchFilters(publisher_name=" wydawnictwo łódź  2"), **lookups).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 25 % 12 = 3 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_publisher_domain(t):
    docs, lookups = _library(t)
    return apply_filters(docs, SearchFilters(publisher_domain="https://www.n3.example.com:443/x?y", document_types=("1-URGENT", "5-LOW")), **lookups).select("id")


@query("SELECT o_orderkey AS id FROM orders JOIN region ON r_regionkey = o_orderkey % 5 WHERE o_orderkey % 7 % 3 = 1 AND r_name = 'ASIA'")
def filter_source_and_collection(t):
    docs, lookups = _library(t)
    return apply_filters(docs, SearchFilters(discovery_source="ZRODLO 1", collection="ASIA"), **lookups).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10 IN (4, 6) ELSE o_custkey % 10 = 5 END")
def filter_author_alias(t):
    """Authors by name or alias where documents have any, else by the byline; marks and case aside."""
    o, p = t("orders"), F.col("o_custkey") % 10
    docs = o.select(F.col("o_orderkey").alias("id"), F.when(p == 5, "tekst: ŻANETA Łuk, foto").otherwise("inni").alias("byline"))
    authors = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("document_id"), p.alias("person_id"), F.when(p == 4, "Żaneta  Łuk").otherwise("Jan").alias("name"))
    aliases = o.sparkSession.createDataFrame([(6, "zaneta luk"), (6, "ZŁ"), (7, "Żaneta")], "person_id long, alias string")
    return apply_filters(docs, SearchFilters(author_name="Zaneta Łuk"), authors=authors, aliases=aliases).select("id")


_SECTIONS = [
    ("intro\n## A {}\none\n\ntwo\n## B\n", [("A {}", "one\n\ntwo"), ("B", "")]),
    ("# Title\n### Sub\nno {}", []),
    ("## Only {}", [("Only {}", "")]),
    ("##No space\n## Yes\n  {}  ", [("Yes", "{}")]),
    ("", []),
    (None, []),
    ("## {} \n### Inner\nstays\n## {}\nx", [("{}", "### Inner\nstays"), ("{}", "x")]),
    (" ## indented\ntext", []),
    ("## Q1?\n- a\n- b {}", [("Q1?", "- a\n- b {}")]),
    ("text ## inside\n## Last {}\nend", [("Last {}", "end")]),
]


@query(shaped_sql([(k, n, *f) for k, (_, found) in enumerate(_SECTIONS) for n, f in enumerate(found)], "position, title, body", len(_SECTIONS)))
def note_sections(t):
    rows = shaped(t, [r[:1] for r in _SECTIONS], "note string")
    return rows.select("doc_id", F.posexplode(markup.sections(F.col("note"))).alias("position", "s")).select("doc_id", "position", "s.title", F.col("s.text").alias("body"))


_CHAPTERS = [
    ("intro {}\n# A\nbody {}\n# B\nend", 2, "A", "# A\nbody {}"),
    ("intro {}\n# A\nbody\n# B\nend", 1, "(wstęp)", "intro {}"),
    ("intro\n# A\nbody\n# B {}\nend\n\n", 3, "B {}", "# B {}\nend"),
    ("intro\n# A\nbody\n# B\nend {}", 4, None, None),
    ("# A\n## C {}\nx\n## D\ny", 2, "C {}", "## C {}\nx"),
    ("\n\n## C {}\nx\n## D\ny", 1, "C {}", "## C {}\nx"),
    ("no chapters {}", 1, None, None),
    ("# A {}", 0, None, None),
    (None, 1, None, None),
    ("# A {} #\nx", 1, "A {}", "# A {} #\nx"),
]


@query(shaped_sql([r[2:] for r in _CHAPTERS], "title, body"))
def chapter_slices(t):
    rows = shaped(t, [r[:2] for r in _CHAPTERS], "note string, position int")
    return rows.select("doc_id", chunking.chapter_text(F.col("note"), F.col("position")).alias("c")).select("doc_id", "c.title", F.col("c.text").alias("body"))


def _runs(t):
    """Conversations as runs: user turns as content, the others as ads, cut in half by a rewrite."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "user", "TEMAT").otherwise("REKLAMA")
    row = F.struct(F.col("turn").alias("index"), kind.alias("type"), F.concat(F.lit("t<"), "turn", F.lit(">")).alias("topic"), text.alias("original"), F.left(text, F.ceil(F.length(text) / 2).cast("int")).alias("corrected"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("s"), "turn")).alias("summary"))
    return t("conversations").where("role IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("chunks"))


@query("""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, left(coalesce(text, ''), ceil(length(coalesce(text, '')) / 2.0)::INT) AS half FROM conversations WHERE role IS NOT NULL)
SELECT conv_id, count(*) AS chunks, count(*) FILTER (role = 'user') AS content, count(*) FILTER (CASE WHEN length(text) > 0 THEN round(100 * length(half) / length(text)::DOUBLE, 1) ELSE 0 END < 80) AS short,
  sha256('# run ' || conv_id || chr(10) || chr(10) || string_agg('### ' || turn || '. t<' || turn || '>' || chr(10) || chr(10) || CASE WHEN role = 'user' AND turn % 3 > 0 THEN '**s' || turn || '**' || chr(10) || chr(10) ELSE '' END || half, chr(10) || chr(10) ORDER BY turn)) AS markdown,
  sha256('<html><body><h1>run ' || conv_id || '</h1>' || string_agg('<h3>' || turn || '. t&lt;' || turn || '&gt;</h3><p>' || replace(replace(replace(half, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY turn) || '</body></html>') AS html
FROM c GROUP BY conv_id
""")
def run_exports(t):
    title = F.concat(F.lit("run "), "conv_id")
    told = F.from_json(transcripts.run_json(F.col("conv_id"), title, F.col("chunks")), "meta struct<doc_id:long,title:string,chunk_count:long,content_chunks:long,short_chunks:long>")["meta"]
    runs = _runs(t).withColumn("m", told)
    return runs.select("conv_id", F.col("m.chunk_count").alias("chunks"), F.col("m.content_chunks").alias("content"), F.col("m.short_chunks").alias("short"), F.sha2(transcripts.run_markdown(title, F.col("chunks")), 256).alias("markdown"), F.sha2(transcripts.run_html(title, F.col("chunks")), 256).alias("html"))
