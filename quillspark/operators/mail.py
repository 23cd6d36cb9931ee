"""Bodies of mail messages whose parts nest to any depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body_text(data: Column) -> Column:
    """Text of base64url data, with or without its padding; bytes that aren't UTF-8 become replacement marks. Null where it isn't base64."""
    plain = F.regexp_replace(F.translate(data, "-_", "+/"), r"[=\s]+$", "")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def header(payload: Column, name: str) -> Column:
    """The first header of a name, in any case, of a message's payload (VARIANT)."""
    headers = F.coalesce(F.try_variant_get(payload, "$.headers", "array<struct<name string, value string>>"), F.array().cast("array<struct<name string, value string>>"))
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def body_parts(mails: DataFrame, mime: str, key: str = "id", payload: str = "payload", keep: Callable[[DataFrame], DataFrame] | None = None, most_depth: int = 64) -> DataFrame:
    """(key, place, text): the first part of a type, in the order of the message, that has a body.

    mails: key, payload (JSON text). Parts are opened level by level, all messages at a time, as long as any has parts: a part's place is the
    array of its numbers, so a part comes before its own parts and those before its next neighbour. keep(df) holds a level, which is
    read again for its bodies and for the next level (default: persist). Messages without such a part, or whose payload isn't JSON, have no row.
    """
    keep = keep or (lambda df: df.persist())
    level = keep(mails.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("place"), F.try_parse_json(payload).alias("part")))
    bodies = []
    for _ in range(most_depth):
        told = level.select("k", "place", F.try_variant_get("part", "$.mimeType", "string").alias("mime"), body_text(F.try_variant_get("part", "$.body.data", "string")).alias("text"))
        bodies.append(told.where((F.col("mime") == mime) & (F.col("text") != "")).select("k", "place", "text"))
        level = keep(level.select("k", "place", F.posexplode(F.try_variant_get("part", "$.parts", "array<variant>")).alias("n", "sub")).select("k", F.concat("place", F.array("n")).alias("place"), F.col("sub").alias("part")))
        if level.isEmpty():
            break
    else:
        raise ValueError(f"parts nest deeper than {most_depth}")
    every = bodies[0]
    for b in bodies[1:]:
        every = every.unionByName(b)
    return every.groupBy("k").agg(F.min(F.struct("place", "text")).alias("b")).select(F.col("k").alias(key), "b.place", "b.text")
