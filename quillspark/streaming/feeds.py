"""Feeds and file events as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url
from ..operators.incremental import upsert_latest


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def merge_entries(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Feed entries by (feed, canonical URL): the first time seen stays, the last and the title move on."""
    fresh = batch.select("feed", canonical_url(F.col("url")).alias("key"), "title", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
    both = old.select("feed", "key", "title", "first_seen", "last_seen").unionByName(fresh)
    return both.groupBy("feed", "key").agg(F.max_by("title", "last_seen").alias("title"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def current_paths(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Where each bucket of a table of upsert_table stands, after all batches or those before a number: as many entries as buckets."""
    batches = [int(r["batch"]) for r in _log(spark, target).select("batch").distinct().collect()]
    past = [n for n in batches if before is None or n < before]
    return {r["bucket"]: r["path"] for r in _log(spark, target).where(F.col("batch") == max(past)).collect()} if past else {}


def _log(spark: SparkSession, target: str) -> DataFrame:
    try:
        return spark.read.schema("bucket int, path string, batch long").parquet(f"{target}/log")
    except AnalysisException:  # nothing is written yet
        return spark.createDataFrame([], "bucket int, path string, batch long")


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a table of upsert_table, as of its last batch."""
    return spark.read.parquet(*current_paths(spark, target).values())


def upsert_table(stream: DataFrame, target: str, checkpoint: str, keys: list[str], at: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the newest row of each key in a parquet table in buckets of the keys' hash.

    A batch reads and writes anew only the buckets that its keys fall into, then logs where each bucket stands: that log is
    what makes a batch count. A batch that runs again after a failure starts from the batches before it and writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in batch.columns if c not in (*keys, at)])).alias("r")).select(*keys, "r.*").select(*batch.columns)
        old = current_paths(spark, target, number)
        touched = [r["b"] for r in batch.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
        read = [old[b] for b in touched if b in old]
        out = upsert_latest(spark.read.schema(batch.schema).parquet(*read), newest, keys, at) if read else newest
        out.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/batch={number}")
        stands = old | {b: f"{target}/data/batch={number}/bucket={b}" for b in touched}
        if stands:
            spark.createDataFrame(sorted(stands.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{target}/log/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_key(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Idempotent enqueue: the first event of a key within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def debounced(stream: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """Bursts of events of a key as one row when the gap has passed."""
    found = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events"))
    return found.select(key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closed_at"), "events")


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str, delay: str) -> DataFrame:
    """Counts by kind over tumbling windows; rows later than the delay are dropped."""
    found = stream.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), kind, "n")
