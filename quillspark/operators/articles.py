"""Articles from the markdown of portal pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, splitting
from ..functions import site_lines as S
from ..functions.captions import captions
from ..functions.portal import article_lines
from ..functions.text import strip


def clean_articles(df: DataFrame, text: str, url: str) -> DataFrame:
    """df with a column `article` of (text, links, images, portal, source) from the markdown of pages and their addresses.

    Broken links are joined, pictures and links become numbered markers with their captions, then the lines go that any portal,
    and those that this portal puts into articles. Null and empty texts give an empty text; unknown sites get the rules for any.
    A column `article` of df is replaced. There is no shuffle: each step is a projection, in time that grows with the text and,
    within a text, with the square of its pictures or links.
    """
    raw, name = F.coalesce("text", F.lit("")), F.col("portal")
    known = F.when(name == "onet", S.without_summary(raw)).when(name == "interia", S.without_rows(S.without_rows(raw, S.MENU), S.REACTIONS)).otherwise(raw)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "article"]).alias("row"), F.col(text).alias("text"), F.col(url).alias("url"))
    rows = rows.withColumn("portal", S.site_name(F.col("url"))).withColumn("text", known)
    rows = rows.withColumn("told", F.when(name == "interia", S.reprint(F.col("text"))).otherwise(F.struct("text", F.lit(None).cast("string").alias("source"))))

    whole = markup.brackets_in_one_line(splitting.whole_links(F.col("told.text")))
    card = lambda x: F.startswith(strip(x), F.lit("[![")) & F.contains(x, F.lit("#### "))
    lines = F.array_join(F.filter(F.split("text", r"\r?\n"), lambda x: ~card(x) & ~S.own_tags(strip(x))), "\n")
    rows = rows.withColumn("text", whole).withColumn("text", lines).withColumn("pictures", S.pictures(F.col("text")))
    rows = rows.withColumn("text", F.regexp_replace("pictures.text", r"\[(\[img\d+[^\]]*\])\]\([^)]+\)", "$1"))
    rows = rows.withColumn("captions", captions(F.col("text"), F.col("url"))).withColumn("images", S.captioned(F.col("captions"), F.col("pictures.found")))
    rows = rows.withColumn("text", S.without_captions_told(F.col("text"), F.col("captions"))).withColumn("links", S.links(F.col("text")))

    old = F.regexp_replace(F.regexp_replace("links.text", r'picture\[\d+\]:"[^"]*"', ""), r"link\[\d+\]:[^\n]*", "")
    rows = rows.withColumn("text", F.regexp_replace(F.replace(S.known_markers(old, F.size("images")), F.lit("\xa0"), F.lit(" ")), " +", " "))
    rows = rows.withColumn("text", article_lines(F.col("text"))).withColumn("text", S.portal_lines(F.col("text"), F.col("url")))
    clean = strip(F.regexp_replace("text", r"\n{3,}", "\n\n"))
    pairs = F.transform("links.found", lambda r: F.struct(r["text"].alias("text"), r["url"].alias("url")))
    return rows.select("row.*", F.struct(clean.alias("text"), pairs.alias("links"), "images", "portal", F.col("told.source").alias("source")).alias("article"))
