"""Exact line deduplication over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, keeps_names, let, lower_az, steps, stored, with_columns


@keeps_names
def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops lines that many documents hold, except in the document of the largest id.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of min_chars code points or
    more in min_docs documents or more lose all their lines outside the largest id that holds them. The lines are exploded
    and hashed to 128 bits; documents are counted per hash in two steps (hash and id, then hash), so that a line of every
    document is spread over all tasks; the drops go back to the documents as positions.

    Adds n_lines, n_dropped and kept_text (replacing input columns of these names); all other columns and rows stay.
    Null or empty text is one empty line. A null id counts as one document, below all others. Repeated rows of one id
    count once and are treated alike. An empty table gives an empty table.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.posexplode(lines).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("id", "version", "pos", lower_az(F.btrim("line", F.lit(SPACE_CHARS))).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # stored, so that the join's both sides are plain shuffles and a hot line's rows are split over tasks
    common = stored(
        rows.groupBy("h1", "h2")
        .agg((F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = (
        rows.join(common, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__drop_id"), F.col("version").alias("__drop_version"))
        .agg(F.collect_set("pos").alias("__drop"))
    )
    joined = docs.join(drops, docs[id_col].eqNullSafe(F.col("__drop_id")) & (F.xxhash64(docs[text_col]) == F.col("__drop_version")), "left")
    text = F.coalesce(docs[text_col], F.lit(""))
    drop = F.col("__drop")
    kept = let(F.split(text, "\n"), lambda ls: F.array_join(F.transform(F.array_except(steps(F.size(ls)), drop), lambda p: F.get(ls, p)), "\n"))
    return with_columns(
        joined,
        ["__drop_id", "__drop_version", "__drop"],
        n_lines=F.size(F.split(text, "\n")).cast("long"),
        n_dropped=F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long"),
        kept_text=F.when(drop.isNull(), text).otherwise(kept),
    )
