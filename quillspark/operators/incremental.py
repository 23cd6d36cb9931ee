"""Keyed merges, claims and recovery over batches; streaming/ applies the same to streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds to wait before the next attempt, and without a heartbeat until a job is stale.
BACKOFF = (30, 120, 600)
STALE_SECONDS = 120


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Both tables' rows, the newest of each key; of equal times the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("__new")))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the new rows whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_for(old: DataFrame, new: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Derived rows of the keys in `new` are replaced; rows that `keep` names stay."""
    stay = old.join(new.select(key).distinct(), key, "left_anti")
    if keep is not None:
        stay = stay.unionByName(old.where(keep).join(new.select(key).distinct(), key, "left_semi"))
    return stay.unionByName(new.select(*old.columns))


def claim(jobs: DataFrame, now: Column, types: list[str], slots: int) -> DataFrame:
    """The next jobs to run: queued, due, of these types, oldest first."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= now) & F.col("type").isin(*types))
    return ready.orderBy("available_at", "id").limit(slots)


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs without a recent heartbeat go back to the queue with a delay, or fail after their last attempt."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_dt_interval(secs=F.lit(STALE_SECONDS)))
    out = F.col("attempt") >= F.col("max_attempts")
    delay = F.element_at(F.array(*[F.lit(s) for s in BACKOFF]), F.least(F.greatest(F.col("attempt"), F.lit(1)), F.lit(len(BACKOFF))).cast("int"))
    return jobs.withColumns(
        {
            "status": F.when(stale & out, "failed").when(stale, "queued").otherwise(F.col("status")),
            "available_at": F.when(stale & ~out, now + F.make_dt_interval(secs=delay)).otherwise(F.col("available_at")),
        }
    )


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Events of a key with pauses of at most the gap, as one row: debounced changes."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) > F.lag(at).over(w) + F.make_dt_interval(secs=F.lit(gap_seconds)), 1).otherwise(0)
    marked = events.withColumn("__n", new).withColumn("__s", F.sum("__n").over(w))
    return marked.groupBy(key, "__s").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events")).drop("__s")
