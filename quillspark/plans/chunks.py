"""Splitters, chapters and timed transcripts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking as C
from .registry import query


def _rows(df, key, chunks):
    return df.select(key, F.posexplode(chunks).alias("position", "chunk"))


@query()
def sentence_chunks(t):
    return _rows(t("documents"), "doc_id", C.sentence_chunks(F.col("text"), 800))


@query()
def para_chunks(t):
    return _rows(t("documents"), "doc_id", C.paragraph_chunks(F.col("text"), 800))


@query()
def md_chunks(t):
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## part\n\n")))
    return _rows(t("documents").withColumn("text", marked), "doc_id", C.markdown_chunks(F.col("text"), 800))


@query("""
SELECT doc_id, 1 AS position, '(wstęp)' AS title FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, CASE WHEN source = 'src1' THEN 2 ELSE 1 END, 'A ' || doc_id FROM documents UNION ALL SELECT doc_id, CASE WHEN source = 'src1' THEN 3 ELSE 2 END, 'B' FROM documents
""")
def chapters(t):
    text = F.concat(F.when(F.col("source") == "src1", "intro\n").otherwise(""), F.lit("# A "), F.col("doc_id"), F.lit(" ##\nbody\n## inner\nmore\n# B\nend\n"))
    return t("documents").select("doc_id", F.explode(C.chapters(text)).alias("c")).select("doc_id", "c.position", "c.title")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('# ' || text, '(?m)^#{1,6} ', '', 'g'), '\*\*|__', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), ' ') AS plain FROM documents")
def plain_markdown(t):
    return t("documents").select("doc_id", F.trim(C.plain_markdown(F.concat(F.lit("# "), F.col("text")))).alias("plain"))


@query("SELECT event_id, (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)))::BIGINT AS seconds, strftime(ts, '%H:%M:%S') AS clock FROM events")
def time_to_seconds(t):
    s = C.clock_seconds(F.date_format("ts", "HH:mm:ss"))
    return t("events").select("event_id", s.cast("long").alias("seconds"), C.clock(s).alias("clock"))


@query("""
WITH c AS (SELECT * FROM (VALUES (0, 'night'), (21600, 'morning'), (43200, 'day'), (64800, 'evening')) v(start, title)), e AS (SELECT event_id, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS s FROM events)
SELECT event_id, (SELECT max_by(title, start) FROM c WHERE start <= s) AS title FROM e
""")
def chapter_asof(t):
    """Each time in its chapter: chapters end where the next begins, and the range join is one on few chapters."""
    listing = t("region").sparkSession.range(1).select(F.split(F.lit("0:00:00 night\n6:00:00 morning\n12:00:00 day\n18:00:00 evening"), "\n").alias("l"))
    parts = listing.select(F.posexplode("l").alias("pos", "line")).select("pos", C.clock_seconds(F.regexp_extract("line", r"^(\S+)", 1)).alias("start"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("title"))
    chapters = parts.withColumn("end", F.lead("start").over(Window.orderBy("pos")))
    e = t("events").select("event_id", C.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("s"))
    return e.join(F.broadcast(chapters), (F.col("start") <= F.col("s")) & (F.col("end").isNull() | (F.col("s") < F.col("end")))).select("event_id", "title")


@query()
def text_windows(t):
    return _rows(t("documents"), "doc_id", C.windows(F.col("text"), 500))
