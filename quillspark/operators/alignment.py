"""Texts that went through an edit, placed in what they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def end_of_match(stream: Column, first: Column, wanted: Column, slack: int) -> Column:
    """Where the wanted words end if they follow each other in the stream from place first (from 0), with at most `slack` words between them; null if they don't."""
    here = F.slice(stream, first + 1, F.size(wanted) + slack)
    step = lambda s, w: F.when(s["k"] == F.size(wanted), s).otherwise(F.struct((s["k"] + F.when(F.get(wanted, s["k"]) == w, 1).otherwise(0)).alias("k"), (s["n"] + 1).alias("n")))
    found = F.aggregate(here, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n")), step)
    return F.when(found["k"] == F.size(wanted), first + found["n"])


def chunk_segments(segments: DataFrame, chunks: DataFrame, key: str, tail: int = 8, slack: int = 6, least_window: int = 80) -> DataFrame:
    """(key, chunk, first_segment, end_segment): the run of segments that each chunk of an edited transcript covers.

    segments and chunks are (key, position, text). A chunk's border is where its last `tail` words follow each other among the words of the
    segments, words that the edit left out being skipped, as near as can be to the place that its share of all
    characters tells; ties go to the earlier place. Where they aren't found within an eighth of the words (least_window at least),
    that share of the segments is the border. Borders never go back. Numbers are from 0, ends are exclusive; a leading `>>` of a
    segment isn't a word. Without segments or characters both are null. A document's words are one array, as its text is one value.
    """
    spoken = F.regexp_replace(strip(F.coalesce("text", F.lit(""))), "^>>", "")
    told = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", words(spoken).alias("words")))).alias("segments"))
    told = told.select(
        F.col(key).alias("k"),
        F.size("segments").alias("n"),
        F.flatten(F.col("segments.words")).alias("stream"),
        F.flatten(F.transform("segments", lambda s, i: F.array_repeat(i, F.size(s["words"])))).alias("segment_of"),
    )
    in_order = Window.partitionBy(key).orderBy("position")
    text = F.coalesce("text", F.lit(""))
    spans = chunks.select(
        key,
        (F.row_number().over(in_order) - 1).alias("chunk"),
        F.sum(F.length(text)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum(F.length(text)).over(Window.partitionBy(key)).alias("total"),
        F.lead(F.lit(True)).over(in_order).isNull().alias("last"),
        F.slice(F.reverse(words(text)), 1, tail).alias("tail"),
    ).withColumn("tail", F.reverse("tail"))
    grouped = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "upto", "total", "last", "tail"))).alias("chunks"))
    both = grouped.join(told, grouped[key].eqNullSafe(told["k"]), "left")

    stream, n = F.col("stream"), F.size("stream")

    def border(c: Column) -> Column:
        share = c["upto"] / c["total"]
        guess = F.bround(n * share).cast("int")
        reach = F.greatest(F.lit(least_window), F.floor(n / 8).cast("int"))
        low, high = F.greatest(guess - reach, F.lit(0)), F.least(guess + reach, n)
        starts = F.filter(F.sequence(low, F.greatest(high - 1, low)), lambda i: (i < high) & (F.get(stream, i) == F.get(c["tail"], F.lit(0))))
        ends = F.transform(starts, lambda i: F.struct(F.abs(i - guess).alias("away"), i.alias("at"), end_of_match(stream, i, c["tail"], slack).alias("end")))
        end = F.array_min(F.filter(ends, lambda e: e["end"].isNotNull()))["end"]
        place = F.when(end >= n, F.col("n")).otherwise(F.get("segment_of", end))
        return F.when(c["last"], F.col("n")).otherwise(F.coalesce(place, F.bround(F.col("n") * share).cast("int")))

    found = both.select(key, F.explode("chunks").alias("c"), "n", "stream", "segment_of").select(key, "c.chunk", F.when(F.col("c.total") > 0, border(F.col("c"))).alias("border"))
    end = F.max("border").over(Window.partitionBy(key).orderBy("chunk"))
    bordered = found.withColumn("end_segment", end)
    before = F.lag("end_segment", 1, 0).over(Window.partitionBy(key).orderBy("chunk"))
    return bordered.select(key, "chunk", F.when(F.col("end_segment").isNotNull(), before).alias("first_segment"), "end_segment")
