"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps_names, with_columns


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A weight in [0.25, 1]: 1 where words are five characters long on average, less the further from it."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.when(size > 0, F.lit(0.25) + 0.75 * F.least(mean / 6.0, 6.0 / F.greatest(mean, F.lit(0.5)))).otherwise(0.25)


def key_range(key: Column, bins: int) -> Column:
    """The number of a positive key's range, of `bins` a doubling. It is told never to be null, so that no join filters rows by it, which would compute keys twice."""
    return F.coalesce(F.floor(F.log2(key) * bins), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """The words that each source is to give: share of all words by weight, none above `most` times its own.

    Giving what is above a cap to the others by weight until none is above ends at min(cap, level * weight) for one
    level, found here from running sums over the sources ordered by cap / weight. One row per source goes through one
    window; documents don't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # with the sources before this one at their caps, the level that the rest would reach
    level = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every)
    at = F.min(F.when((F.col("level") <= F.col("ratio")) & (F.col("ratio") == first), F.col("level"))).over(every)
    out = levels.withColumn("fits", F.coalesce(at, fits))
    return out.select("source", "source_size", F.when(F.col("fits").isNull() | (F.col("ratio") < F.col("fits")), F.col("cap")).otherwise(F.col("fits") * F.col("weight")).alias("target"))


@keeps_names
def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: int = 17,
    bins: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of each document, so that each source comes to its target.

    Sources in order of name (null last) have the weights in turn. A source takes each of its documents whole as often
    as its size fits into its target, then a fraction: documents in order of their Efraimidis-Spirakis keys,
    -ln(u) / quality with u from a hash of id and seed, until the words left are used up; the document at the edge is
    taken in part, so taken words meet the target rounded down. Prefix sums are taken in two levels, of key ranges and
    within each, so no task holds a source: a doubling of keys has `bins` ranges, and as of exponential variates of any weight at most 0.26
    fall within one doubling, a range has at most 0.26 / bins of a source, whatever the weights of its documents.

    Adds size, source_size, target, epochs, taken (replacing input columns of these names); all rows stay, with taken 0 where
    unused. Null or empty text has size 0 and is never taken. Null sources are one source; null ids
    are told apart by their texts, ties and repeated rows by size alone and otherwise alike, so results are the same on every run. Empty in, empty out.
    """
    size = text_size(F.col(text_col))
    sized = with_columns(docs, [], size=size)
    weight = quality if quality is not None else text_quality(F.col(text_col), F.col("size"))
    told = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.xxhash64(text_col)))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", told, F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    # keys without nulls, so that the windows and the join share one partitioning and rows are shuffled once
    named = {"__s": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__n": F.col(source_col).isNull()}
    keyed = with_columns(sized, [], __key=-F.log(u) / F.greatest(weight, F.lit(1e-6)), **named)
    keyed = with_columns(keyed, [], __bin=key_range(F.col("__key"), bins))

    narrow = sized.select(F.col(source_col).alias("source"), "size")
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"), F.col("source_size").alias("__total"), F.col("target").alias("__target"))
    per_bin = keyed.groupBy("__s", "__n", "__bin").agg(F.sum("size").alias("__sum"))
    upto = Window.partitionBy("__s", "__n").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.withColumn("__offset", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).join(goal, ["__s", "__n"]).drop("__sum")

    within = Window.partitionBy("__s", "__n", "__bin").orderBy("__key", F.col(id_col).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = with_columns(keyed, [], __before=F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(offsets, ["__s", "__n", "__bin"])
    goal_words = F.floor("__target")
    epochs = F.when(F.col("__total") > 0, F.floor(goal_words / F.col("__total"))).otherwise(0).cast("long")
    left = goal_words - epochs * F.col("__total") - F.col("__offset") - F.col("__before")
    part = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return with_columns(
        joined,
        ["__key", "__bin", "__s", "__n", "__total", "__target", "__offset", "__before"],
        source_size=F.col("__total").cast("long"),
        target=F.col("__target"),
        epochs=epochs,
        taken=(epochs * F.col("size") + part).cast("long"),
    )
