"""Helpers that the training-data operators share."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as trim characters and as a pattern for runs of it.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its own; a cluster, whose machines share no local folder, an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Ends lineage by a parquet table in the shared folder: a third of a checkpoint's size, for large results."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: filters and projections above are not merged with it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay. Pure ASCII takes the fast path."""
    az = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(az)


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def steps(n: Column) -> Column:
    """0, 1, ..., n - 1; empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return df[f"`{name.replace('`', '``')}`"]


def with_columns(df: DataFrame, drop: list[str], **new: Column) -> DataFrame:
    """Adds columns (over any of the same name in any case) and drops helpers in one projection."""
    gone = {c.lower() for c in [*drop, *new]}
    return df.select(*[column(df, c) for c in df.columns if c.lower() not in gone], *[v.alias(k) for k, v in new.items()])


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator whose helper columns begin with two underscores: input columns that do so too get other names inside it and theirs back."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        inside: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                inside[c] = next(n for k in range(len(taken) + 1) if (n := f"kept{k}{c}") not in inside.values() and n.lower() not in taken)
        if not inside:
            return operator(docs, *args, **options)
        options = {k: inside.get(v, v) if k.endswith("_col") else v for k, v in options.items()}
        out = operator(docs.select(*[column(docs, c).alias(inside.get(c, c)) for c in docs.columns]), *args, **options)
        outside = {n: c for c, n in inside.items()}
        return out.select(*[column(out, c).alias(outside.get(c, c)) for c in out.columns])

    return run
