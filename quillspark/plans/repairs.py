"""Chunks placed in transcripts, links and groups rewritten, cited sources, books and their contents, brackets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import alignment, attribution, books, rewriting
from .registry import query

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _match_steps(tail: int = 8) -> str:
    """The end of the first match of each tail word after the one before."""
    step = "SELECT *, CASE WHEN len(tail) < {k} THEN e{b} ELSE e{b} + nullif(list_position(here[e{b} + 1:], tail[{k}]), 0) END AS e{k} FROM ({inner})"
    inner = "SELECT *, 1 AS e1 FROM starts"
    for k in range(2, tail + 1):
        inner = step.format(k=k, b=k - 1, inner=inner)
    return inner


_TURNS = f"""
seg AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg, {_WORDS.format("text")} AS ws FROM conversations),
nseg AS (SELECT conv_id, count(*) AS n, flatten(list(ws ORDER BY seg)) AS stream FROM seg GROUP BY conv_id),
w AS (SELECT conv_id, seg, row_number() OVER (PARTITION BY conv_id ORDER BY seg, i) - 1 AS place, word FROM (SELECT conv_id, seg, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM seg)),
kept AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS k FROM w WHERE place % 11 <> 5),
chunk AS (SELECT conv_id, k // 60 AS chunk, string_agg(CASE WHEN conv_id % 10 = 3 AND k % 60 > 50 THEN 'zz' || word ELSE word END, ' ' ORDER BY k) AS text FROM kept GROUP BY ALL)
"""


@query(f"""
WITH {_TURNS},
c AS (SELECT *, {_WORDS.format("text")}[-8:] AS tail, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY chunk) AS upto, sum(length(text)) OVER (PARTITION BY conv_id) AS total, lead(true) OVER (PARTITION BY conv_id ORDER BY chunk) IS NULL AS last FROM chunk),
g AS (SELECT c.*, n, len(stream) AS words, stream, round_even(len(stream) * (upto / total), 0)::INT AS guess, greatest(80, len(stream) // 8) AS reach FROM c JOIN nseg USING (conv_id)),
starts AS (SELECT g.conv_id, chunk, tail, guess, w.place, stream[w.place + 1:w.place + len(tail) + 6] AS here FROM g JOIN w ON g.conv_id = w.conv_id AND w.word = tail[1] AND w.place >= guess - reach AND w.place < least(guess + reach, words) WHERE NOT last),
ends AS (SELECT conv_id, chunk, min({{'away': abs(place - guess), 'place': place, 'end': place + e8}}) AS best FROM ({_match_steps()}) WHERE e8 IS NOT NULL GROUP BY ALL),
border AS (SELECT g.conv_id, g.chunk, CASE WHEN last THEN n WHEN best IS NULL THEN round_even(n * (upto / total), 0)::INT WHEN best['end'] >= words THEN n ELSE (SELECT seg FROM w WHERE w.conv_id = g.conv_id AND w.place = best['end']) END AS b FROM g LEFT JOIN ends ON g.conv_id = ends.conv_id AND g.chunk = ends.chunk),
e AS (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY chunk) AS end_segment FROM border)
SELECT conv_id, chunk, lag(end_segment, 1, 0) OVER (PARTITION BY conv_id ORDER BY chunk) AS first_segment, end_segment FROM e
""")
def chunk_segments(t):
    """Turns as segments; chunks of 60 words from the joined turns, every eleventh word left out as filler; in one of ten conversations the last words of a chunk are others."""
    turns = t("conversations")
    heard = turns.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", alignment.words(F.coalesce("text", F.lit(""))).alias("ws")))), lambda s: s["ws"])).alias("stream"))
    kept = heard.select("conv_id", F.posexplode(F.filter("stream", lambda w, i: i % 11 != 5)).alias("k", "word"))
    word = F.when((F.col("conv_id") % 10 == 3) & (F.col("k") % 60 > 50), F.concat(F.lit("zz"), "word")).otherwise(F.col("word"))
    chunks = kept.groupBy("conv_id", F.floor(F.col("k") / 60).alias("position")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", word.alias("w")))), lambda x: x["w"]), " ").alias("text"))
    return alignment.chunk_segments(turns.select("conv_id", F.col("turn").alias("position"), "text"), chunks, "conv_id")


@query(r"""
WITH d AS (SELECT page_id, url, 'https://go.example/' || page_id % 40 AS l FROM pages)
SELECT page_id, 'See (' || CASE WHEN page_id % 40 % 4 < 3 THEN 'https://news.example/' || (page_id % 40 * 7) ELSE l END || '), or ' || url || '; "' || CASE WHEN page_id % 40 % 4 < 3 THEN 'https://news.example/' || (page_id % 40 * 7) ELSE l END || '"? No: https://go.example/x' || page_id || ' and http:// end.' AS text FROM d
UNION ALL SELECT -1, NULL UNION ALL SELECT -2, 'no link'
""")
def links_rewritten(t):
    """Four links a text, three of four redirects of which have a target."""
    pages = t("pages")
    go = F.concat(F.lit("https://go.example/"), F.col("page_id") % 40)
    text = F.concat(F.lit("See ("), go, F.lit("), or "), "url", F.lit('; "'), go, F.lit('"? No: https://go.example/x'), "page_id", F.lit(" and http:// end."))
    more = pages.sparkSession.createDataFrame([(-1, None), (-2, "no link")], "page_id long, text string")
    n = F.col("page_id") % 40
    targets = pages.where(n % 4 < 3).select(go.alias("url"), F.concat(F.lit("https://news.example/"), n * 7).alias("target"))
    return rewriting.rewrite_links(pages.select("page_id", text.alias("text")).unionByName(more), targets, "page_id")


_RULES = """
r AS (SELECT * FROM (VALUES (1, 'o', '1-urgent', 'author', 'Automobile', NULL, 'Own'), (2, '*', '1-urgent', 'global', NULL, 'X', 'Urgent'), (3, 'F', 'variant f', 'global', NULL, NULL, 'Urgent'), (4, 'O', '5-low', 'author', 'BUILDING', 'O', '4-NOT SPECIFIED'), (5, 'P', '5-low', 'global', NULL, NULL, '5-LOW')) v(rule, match_type, lemma, scope, author, new_type, new_text)),
g AS (SELECT o_custkey AS doc, min(c_mktsegment) AS author, o_orderstatus AS type, o_orderpriority AS text, count(*) AS n, ['Variant ' || o_orderstatus] AS variants FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 3, 4),
m AS (SELECT g.doc, g.type, g.text, min({'rule': rule, 'new_type': new_type, 'new_text': new_text}) AS won FROM g JOIN r ON lower(r.lemma) IN (lower(g.text), lower(g.variants[1])) AND (match_type = '*' OR match_type = g.type) AND (scope = 'global' OR lower(r.author) = lower(g.author)) GROUP BY ALL),
d AS (SELECT g.*, won['rule'] AS rule, coalesce(won['new_type'], g.type) AS type_after, coalesce(won['new_text'], g.text) AS text_after FROM g LEFT JOIN m USING (doc, type, text))
"""


@query(f"""
WITH {_RULES}
SELECT 'group' AS kind, doc, type_after AS type, text_after AS text, sum(n)::BIGINT AS n, string_agg(DISTINCT variants[1], ',' ORDER BY variants[1]) AS told FROM d GROUP BY doc, type_after, text_after
UNION ALL SELECT 'audit', doc, type_after, text_after, rule, type || ':' || text FROM d WHERE rule IS NOT NULL AND (type <> type_after OR text <> text_after)
""")
def corrections_applied(t):
    """Priorities as entities of customers; rules by author, for all, by variant, one that merges and one that changes nothing."""
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("author")), "o_custkey")
    groups = o.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("text")).agg(F.min("author").alias("author"), F.count("*").alias("count"))
    groups = groups.select("doc", "author", "type", "text", "count", F.array(F.concat(F.lit("Variant "), "type")).alias("variants"), F.array().cast("array<string>").alias("lemmas"))
    rules = [(1, "o", "1-urgent", "author", "Automobile", None, "Own"), (2, "*", "1-urgent", "global", None, "X", "Urgent"), (3, "F", "variant f", "global", None, None, "Urgent"), (4, "O", "5-low", "author", "BUILDING", "O", "4-NOT SPECIFIED"), (5, "P", "5-low", "global", None, None, "5-LOW")]
    after, audit = rewriting.apply_corrections(groups, o.sparkSession.createDataFrame(rules, "rule long, match_type string, lemma string, scope string, author string, new_type string, new_text string"), lambda df: df.persist())
    told = after.select(F.lit("group").alias("kind"), "doc", "type", "text", F.col("count").alias("n"), F.array_join("variants", ",").alias("told"))
    return told.unionByName(audit.select(F.lit("audit").alias("kind"), "doc", F.col("type_after").alias("type"), F.col("text_after").alias("text"), F.col("rule").alias("n"), F.concat_ws(":", "type_before", "text_before").alias("told")))


#: Sentences with a mention {} of the document's agency, and what the evidence begins with; None: not cited.
_CITES = [
    ("Jak podaje agencja {}, wojna trwa.", True),
    ("{} otworzył nowe biuro.", False),
    ("Rząd upadł; według {} będą wybory!", True),
    ("Według rządu, {} milczy.", False),
    ("{}, informuje o tym rzecznik.", True),
    ("W komunikacie {} poinformował, że doszło do wyłączeń - podają inni.", False),
    ("W komunikacie EDF poinformował, że doszło do wyłączeń - podają {} oraz inni.", True),
    ("Zdaniem {}x nic się nie stało. Powołując się na dane firmy {} napisano więcej.", "Powołując"),
    ("ZA {} DONOSZĄ", True),
    ("Zakład {} działa.", False),
]
_AGENCY = "'Agencja Q' || doc_id % 37"


def _cited_sql() -> str:
    cases = []
    for k, (said, yes) in enumerate(_CITES):
        told = said[said.index(yes) :] if isinstance(yes, str) else said
        cases += [f"WHEN {k} THEN replace('{told}', '{{}}', {'upper(name)' if k % 2 else 'name'})"] if yes else []
    return f"""
    WITH d AS (SELECT doc_id, {_AGENCY} AS name FROM documents), e AS (SELECT doc_id, name, CASE doc_id % {len(_CITES)} {' '.join(cases)} END AS evidence FROM d)
    SELECT doc_id, name AS source, CASE WHEN doc_id % 2 = 1 THEN upper(name) ELSE name END AS mention, 'organization' AS source_type, NULL::VARCHAR AS domain, evidence FROM e WHERE evidence IS NOT NULL
    UNION ALL SELECT doc_id, 'KCNA', 'KCNA', 'agency', 'kcna.kp', 'Tak twierdzi prasa, powołując się na KCNA' FROM documents WHERE doc_id % 3 = 0
    """


@query(_cited_sql())
def cited_sources(t):
    """A sentence of ten shapes and one on a known agency, put after each document's text."""
    d = t("documents").withColumn("name", F.expr("concat('Agencja Q', doc_id % 37)"))
    said = F.element_at(F.array(*[F.lit(s) for s, _ in _CITES]), (F.col("doc_id") % len(_CITES) + 1).cast("int"))
    mention = F.when(F.col("doc_id") % 2 == 1, F.upper("name")).otherwise(F.col("name"))
    text = F.concat_ws("\n", "text", F.replace(said, F.lit("{}"), mention), F.when(F.col("doc_id") % 3 == 0, "Tak twierdzi prasa, powołując się na KCNA"))
    names = d.select("doc_id", "name", F.array(F.lit(" "), F.lower("name")).alias("variants")).unionByName(d.select("doc_id", F.lit("kcna").alias("name"), F.lit(None).cast("array<string>").alias("variants")))
    return attribution.cited_sources(d.select("doc_id", text.alias("text")), names.unionByName(d.select("doc_id", F.lit("NATO").alias("name"), F.array(F.lit("nato")).alias("variants"))))


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, page, array_to_string(ws[page * 40 + 1:page * 40 + 40], ' ') AS body FROM (SELECT *, unnest(range(0, greatest((len(ws) + 39) // 40, 1))) AS page FROM w)),
q AS (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k, regexp_matches(body, '^[#\-!|]') AS mark, regexp_matches(body, '[a-ząćęłńóśźż0-9,;–—-]$') AS open, regexp_matches(body, '^[a-ząćęłńóśźż]') AS goes_on FROM p WHERE body <> '' AND NOT regexp_matches(body, '^\d{{1,4}}$')),
fold(doc_id, k, text, n, mark, open) AS (
  SELECT doc_id, 1::BIGINT, body, length(body), mark, open FROM q WHERE k = 1 UNION ALL
  SELECT q.doc_id, q.k, f.text || CASE WHEN f.n > 80 AND NOT f.mark AND f.open AND q.goes_on THEN ' ' ELSE chr(10) || chr(10) END || body, CASE WHEN f.n > 80 AND NOT f.mark AND f.open AND q.goes_on THEN f.n + 1 + length(body) ELSE length(body) END,
    CASE WHEN f.n > 80 AND NOT f.mark AND f.open AND q.goes_on THEN f.mark ELSE q.mark END, q.open FROM fold f JOIN q ON f.doc_id = q.doc_id AND q.k = f.k + 1),
said AS (SELECT doc_id, arg_max(text, k) AS text FROM fold GROUP BY doc_id)
SELECT doc_id AS book, sha256(coalesce(text, '') || chr(10)) AS text_sha256 FROM w LEFT JOIN said USING (doc_id)
""")
def books_repaired(t):
    """Each document as a book of pages of 40 words, under a running head in capitals and over a page number."""
    d = t("documents")
    words = d.select("doc_id", alignment.words(F.coalesce("text", F.lit(""))).alias("ws"))
    pages = words.select(F.col("doc_id").alias("book"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("ws") / 40), F.lit(1)).cast("int") - 1)).alias("page"), "ws")
    body = F.array_join(F.slice("ws", F.col("page") * 40 + 1, 40), " ")
    head = F.concat(F.lit("QUILL – RUNNING  HEAD "), "book")
    # a head counts where it stands on three pages; shorter books get a blank line instead
    text = F.concat(F.when(F.size("ws") > 80, head).otherwise(F.lit("")), F.lit("\n\n"), body, F.lit("\n\n "), F.col("page") + 1, F.lit(" \n"))
    out = books.repair_books(pages.select("book", "page", text.alias("text")))
    return out.select("book", F.sha2("text", 256).alias("text_sha256"))


@query("""
SELECT doc_id, '# Book' || chr(10) || 'Spis tresci' || chr(10) || chr(10) || '[1. Intro of ' || doc_id || '](anchor:toc-1)' || chr(10) || chr(10) || '[Notes](anchor:toc-2)' || chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Nowhere' ELSE '[2. Hidden part.](anchor:toc-3)' END || chr(10) || chr(10)
  || '[Notes](anchor:toc-' || CASE doc_id % 3 WHEN 0 THEN 3 ELSE 4 END || ')' || chr(10) || chr(10) || '[#toc-1]' || chr(10) || chr(10) || '## Intro of ' || doc_id || chr(10) || source || chr(10) || '[#toc-2]' || chr(10) || chr(10) || '### Notes' || chr(10) || 'first' || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN '' ELSE '[#toc-3]' || chr(10) || chr(10) || '### Hidden part' || chr(10) || chr(10) END || 'lang ' || lang || ' ... 12' || chr(10) || '[#toc-' || CASE doc_id % 3 WHEN 0 THEN 3 ELSE 4 END || ']' || chr(10) || chr(10) || '## Notes' || chr(10) || 'end' AS text
FROM documents
""")
def contents_linked(t):
    """Printed contents with a numbered entry, a title that two headings share, an entry without heading or one whose title is a plain line."""
    third = F.when(F.col("doc_id") % 3 == 0, "Nowhere . . . . . 7").otherwise("2. Hidden part.  . . . . . 9")
    hidden = F.when(F.col("doc_id") % 3 == 0, "").otherwise("Hidden part\n")
    text = F.concat(F.lit("# Book\nSpis tresci\n1. Intro of "), "doc_id", F.lit(" . . . . . . 3\nNotes ........ 5\n"), third, F.lit("\nNotes . . . . 11\n## Intro of "), "doc_id", F.lit("\n"), "source", F.lit("\n### Notes\nfirst\n"), hidden, F.lit("lang "), "lang", F.lit(" ... 12\n## Notes\nend"))
    return books.link_contents(t("documents").select("doc_id", text.alias("text")))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'front' || chr(10) || '## Spis treści' || chr(10) || 'Intro . . . . 3' || chr(10) || CASE doc_id % 4 WHEN 1 THEN 'Part ' || source || chr(10) || chr(10) WHEN 2 THEN 'Part ' || source ELSE chr(10) END || CASE WHEN doc_id % 4 = 2 THEN '' ELSE '## Intro' || chr(10) || 'Spis treści' || chr(10) || lang END END AS text FROM documents
""")
def contents_chapters(t):
    """Contents whose title is repeated on top of pages, up to the next heading or to the end; one text in four has none."""
    k = F.col("doc_id") % 4
    middle = F.when(k == 1, F.concat(F.lit("spis treści\nPart "), "source", F.lit("\n\n"))).when(k == 2, F.concat(F.lit("SPIS TREŚCI\nPart "), "source")).otherwise(F.lit("\n"))
    rest = F.when(k == 2, "").otherwise(F.concat(F.lit("## Intro\nSpis treści\n"), "lang"))
    text = F.when(k == 3, F.lit("no contents\n## x")).otherwise(F.concat(F.lit("front\nSPIS TREŚCI\nIntro . . . . 3\n"), middle, rest))
    return t("documents").select("doc_id", books.contents_as_chapter(text).alias("text"))


@query(r"""
WITH m AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), ', ', '['), '. ', chr(10) || ']' || chr(10)), 'th', '[' || chr(10) || chr(10)), ' a', ' ' || chr(10) || 'a') || CASE doc_id % 3 WHEN 0 THEN '[x' || chr(10) || '](u)[![y](v)](w)' ELSE '' END AS text FROM documents),
c AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\)(\[!\[)', ')' || chr(10) || chr(10) || '\1', 'g'), '', ''), '')) AS c, generate_subscripts(string_split(regexp_replace(text, '\)(\[!\[)', ')' || chr(10) || chr(10) || '\1', 'g'), ''), 1) AS i FROM m),
l AS (SELECT *, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c),
s AS (SELECT *, c = chr(10) AND depth > 0 AS flat, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS before, lag(c = chr(10) AND depth > 0) OVER (PARTITION BY doc_id ORDER BY i) AS flat_before FROM l)
SELECT doc_id, sha256(coalesce(string_agg(CASE WHEN NOT flat THEN c WHEN flat_before OR before IN (' ', '[') THEN '' ELSE ' ' END, '' ORDER BY i), '')) AS text_sha256 FROM s GROUP BY doc_id
UNION ALL SELECT doc_id, sha256('') FROM m WHERE text = ''
""")
def brackets_joined(t):
    """Commas, sentence ends and letters as brackets and line ends: nested, unbalanced and empty ones."""
    text = F.replace(F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("[")), F.lit(". "), F.lit("\n]\n")), F.lit("th"), F.lit("[\n\n")), F.lit(" a"), F.lit(" \na"))
    more = F.when(F.col("doc_id") % 3 == 0, "[x\n](u)[![y](v)](w)").otherwise("")
    return t("documents").select("doc_id", F.sha2(M.brackets_in_one_line(F.concat(text, more)), 256).alias("text_sha256"))
