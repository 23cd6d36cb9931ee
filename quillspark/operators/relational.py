"""Relational patterns that listings and reports are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int = 50, number: int = 1) -> DataFrame:
    """One page of a totally ordered listing; limits are clamped to 1..100."""
    size = max(1, min(100, limit))
    out = df.orderBy(*order)
    return (out.offset((number - 1) * size) if number > 1 else out).limit(size)


def page_count(rows: int, limit: int) -> int:
    return max(1, math.ceil(rows / max(1, min(100, limit))))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def with_all(links: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Relational division: keys linked to every wanted value."""
    return links.where(F.col(value).isin(*wanted)).groupBy(key).agg(F.count_distinct(value).alias("__n")).where(F.col("__n") == len(set(wanted))).select(key)


def counts_for(left: DataFrame, key: str, right: DataFrame, right_key: str, name: str, zero: bool = True) -> DataFrame:
    """left with the number of matching right rows, pre-aggregated; rows without any stay at 0 if asked for."""
    n = right.groupBy(F.col(right_key).alias("__key")).agg(F.count("*").alias(name))
    out = left.join(n, left[key] == n["__key"], "left" if zero else "inner").drop("__key")
    return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def effective_at(facts: DataFrame, at: str, prices: DataFrame, keys: list[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """facts with the price row in force at each fact's time: equal keys, start <= at < end, a null end being open."""
    p = prices.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (facts[k] == p[f"__{k}"])
    on = on & (p[start] <= facts[at]) & (p[end].isNull() | (facts[at] < p[end]))
    return facts.join(p, on, "left").drop(*[f"__{k}" for k in keys])


def daily(df: DataFrame, day: Column, first: str, last: str, *aggs: Column, zero: list[str]) -> DataFrame:
    """One row a day of a calendar, zeros where a day has no rows."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    found = df.groupBy(day.alias("day")).agg(*aggs)
    out = spine.join(found, "day", "left")
    return out.select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in zero else F.col(c) for c in found.columns if c != "day"])


def total_if_known(value: Column, unit: Column) -> Column:
    """The sum, or null if any part or the unit isn't known, or units differ."""
    whole = (F.count(value) == F.count(F.lit(1))) & (F.count(unit) == F.count(F.lit(1))) & (F.min(unit) == F.max(unit))
    return F.when(whole, F.sum(value))


def neighbours(df: DataFrame, order: str, bucket: int) -> DataFrame:
    """The ids before and after each row in the order of a dense integer key.

    Windows run within buckets of the key; the edges of neighbouring non-empty buckets are joined on, so no task sees
    all rows.
    """
    b = df.withColumn("__bucket", F.floor(F.col(order) / bucket))
    within = Window.partitionBy("__bucket").orderBy(order)
    inner = b.withColumns({"previous_id": F.lag(order).over(within), "next_id": F.lead(order).over(within)})
    edges = b.groupBy("__bucket").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    across = Window.orderBy("__bucket")
    edges = edges.select("__bucket", F.lag("high").over(across).alias("__before"), F.lead("low").over(across).alias("__after"))
    joined = inner.join(edges, "__bucket", "left")  # rows without a key stay, without neighbours
    return joined.withColumns({"previous_id": F.coalesce("previous_id", "__before"), "next_id": F.coalesce("next_id", "__after")}).drop("__bucket", "__before", "__after")


def connected(edges: DataFrame, cut, rounds: int = 64) -> DataFrame:
    """(node, root) with the smallest node of each component of edges (a, b), by alternating stars.

    A round hangs the larger neighbours of each node on its smallest one, then each node's smaller ones, until every component is a
    star around its root: rounds grow with the logarithm of a component's width, and each holds as many rows as edges at
    most. cut(df) ends a round's lineage (a checkpoint). Both stars take minima by partial aggregation first.
    """
    own = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    pairs = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    stamp = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    down = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = stamp(down)
    for _ in range(rounds):
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(pairs(F.col("a"), F.col("m")), pairs(F.col("b"), F.col("m")))).alias("e")).select("e.*").where("a <> b").distinct()
        down = cut(small)
        new = stamp(down)
        if new == told:
            stars = down.select(F.col("a").alias("node"), F.col("b").alias("root"))
            known = stars.unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            return known.unionByName(own.join(known.select("node"), "node", "left_anti"))
        told = new
    raise ValueError("components did not settle")
