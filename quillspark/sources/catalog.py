"""Tables, files and sinks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast only sides that a count shows to be within so many rows.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Catalog:
    """Parquet tables under one path, local or in any store that Spark reads."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def register(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A relational table read in ranges of an integer key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored files as rows: key below the path, size, modification time, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("key"), "path", "length", "modificationTime", "content")


def folder_usage(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(folder, files, bytes) of all files below a path by their first `depth` folders; the root's own files have an empty name. Names and sizes are read, no contents. The reader leaves empty files out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    scheme = r"^[a-z0-9]+:/+"
    inner = F.substring(F.regexp_replace("path", scheme, "/"), len(re.sub(scheme, "/", full)) + 2, 1 << 20)
    folders = F.slice(F.split(inner, "/"), 1, F.least(F.lit(depth), F.size(F.split(inner, "/")) - 1))
    return files.groupBy(F.array_join(folders, "/").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def rules_file(spark: SparkSession, path: str) -> dict:
    """A small JSON file of rules, wherever Spark reads files; an empty one where there is none."""
    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return {}
    return json.loads(found.value) if found else {}


def pattern_lines(spark: SparkSession, path: str) -> list[str]:
    """The patterns of a small text file, a line each: blank lines and those that begin with # are left out; the order stays."""
    found = spark.read.text(path, wholetext=True).first()
    lines = [x.rstrip("\r") for x in (found.value if found else "").split("\n")]
    return [x for x in lines if x.strip() and not x.lstrip().startswith("#")]


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; lines that don't parse are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is within the bound, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
