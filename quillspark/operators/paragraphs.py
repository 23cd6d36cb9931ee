"""Paragraphs from proposals over overlapping windows of sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentence_list(text: Column) -> Column:
    """Sentences with the white space before them, so that they join to the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s).+?(?:[.!?…]+(?=\s|$)|$)"), F.lit(0)), lambda s: F.trim(s) != "")


def windows(sentences: DataFrame, size: int, step: int) -> DataFrame:
    """(key, window, sentences array(struct(at, sentence))) of sentences (key, at, sentence): a window begins every `step` sentences and holds `size`."""
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / step)).cast("int")
    spread = sentences.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("at") / step).cast("int"))))
    return spread.groupBy("key", "window").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("sentences"))


def paragraphs(docs: DataFrame, propose: Callable[[DataFrame], DataFrame], size: int = 12, step: int = 6, share: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_paragraphs): texts with a blank line wherever enough of the windows that saw both sides of a border proposed it.

    propose gets windows (key, window, sentences) and gives (key, window, after): the number of a sentence, as in its window's `at`, after which a paragraph may end. It
    stands for a model that is asked in batches. What it says of a window's last sentence, or of sentences that the window doesn't hold, counts
    as nothing. Windows overlap, so each border but those near the ends is judged by size / step of them, wherever windows fall.
    Keys must be unique; texts without sentences stay as they are.
    """
    rows = docs.select(F.col(key).alias("key"), F.posexplode(sentence_list(F.coalesce(F.col(text), F.lit("")))).alias("at", "sentence"))
    seen = windows(rows, size, step)
    borders = seen.select("key", "window", F.explode(F.transform(F.slice("sentences", 1, size), lambda s: s["at"])).alias("after"), F.element_at("sentences", -1)["at"].alias("last")).where("after < last").drop("last")
    votes = propose(seen).select("key", "window", "after", F.lit(1).alias("yes")).distinct()
    judged = borders.join(votes, ["key", "window", "after"], "left").groupBy("key", "after").agg((F.count("yes") >= share * F.count("*")).alias("cut"))
    cuts = judged.where("cut").select("key", (F.col("after") + 1).alias("at"), F.lit(True).alias("new"))
    put = F.when(F.col("new"), F.concat(F.lit("\n\n"), F.regexp_replace("sentence", r"^\s+", ""))).otherwise(F.col("sentence"))
    whole = rows.join(cuts, ["key", "at"], "left").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", put.alias("s")))), lambda x: x["s"]), "").alias("new_text"), (F.count("new") + 1).alias("n"))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("old")).join(whole, "key", "left").select(F.col("key").alias(key), F.coalesce("new_text", "old").alias(text), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"))
