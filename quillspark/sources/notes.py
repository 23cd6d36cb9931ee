"""Versioned notes: appended versions, counted by commit files that are created once."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, content_before string, content_after string, tool long, prompt string"


class Conflict(Exception):
    """Another writer changed the same notes since the version that this one began from."""


def inside(path: Column) -> Column:
    """Whether a note's path stays below the folder: relative, and never above its own start."""
    parts = F.split(path, "/")
    depth = lambda s, p: F.struct((s["now"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("now"), F.least(s["least"], s["now"] + F.when(p == "..", -1).otherwise(0)).alias("least"))
    end = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), depth)
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & (end["least"] >= 0) & (end["now"] > 0), F.lit(False))


def with_before(versions: DataFrame) -> DataFrame:
    """versions (path, version, content_after) with content_before: what the note held until then, null for a new one."""
    return versions.withColumn("content_before", F.lag("content_after").over(Window.partitionBy("path").orderBy("version")))


def notes_at(versions: DataFrame, version: int | None = None) -> DataFrame:
    """(path, content, version): each note as of a version, or as of the last."""
    known = versions if version is None else versions.where(F.col("version") <= version)
    return known.groupBy("path").agg(F.max_by("content_after", "version").alias("content"), F.max("version").alias("version"))


class NoteStore:
    """A folder of notes with all their versions, on a file system that creates a file for one writer only (HDFS and local ones do).

    A batch of notes is written under a name of its own first, then counts from the moment that its commit file exists: a file whose name is the
    version's number and that the file system creates for one writer only. Readers list the commits and read nothing else, so half a
    batch is never seen. A writer that finds its number taken goes on behind the others if they touched none of its notes; if they
    did, it gets a Conflict and its batch stays unread.
    """

    def __init__(self, spark: SparkSession, folder: str, patience: float = 30):
        self.spark, self.folder, self.patience = spark, folder, patience
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/commits"))

    def commits(self) -> dict[int, str]:
        """The batch of each version: one small file a commit."""
        found = self._fs.listStatus(self._path(f"{self.folder}/commits"))
        names = [f.getPath().getName() for f in found]
        return {int(v): batch for v, _, batch in (n.partition("-") for n in names if n[:1].isdigit())}

    def last(self) -> int:
        return max(self.commits(), default=0)

    def versions(self, upto: int | None = None, after: int = 0) -> DataFrame:
        """(path, version, content_before, content_after, tool, prompt) of committed batches."""
        counted = {v: b for v, b in self.commits().items() if v > after and (upto is None or v <= upto)}
        numbers = self.spark.createDataFrame([(b, v) for v, b in counted.items()], "batch string, version long")
        if not counted:
            return self.spark.createDataFrame([], f"version long, {SCHEMA}")
        rows = self.spark.read.schema(f"{SCHEMA}, batch string").option("basePath", f"{self.folder}/batches").parquet(*[f"{self.folder}/batches/batch={b}" for b in counted.values()])
        return rows.join(F.broadcast(numbers), "batch").drop("batch")

    def read(self, version: int | None = None) -> DataFrame:
        """(path, content, version)."""
        return notes_at(self.versions(version))

    def _claim(self, number: int, batch: str) -> bool:
        """Whether this writer is the one that makes the version. Its claim and the batch's name are one file, so there is no moment between them."""
        claim = self._path(f"{self.folder}/claims/{number}")
        try:
            out = self._fs.create(claim, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps({"batch": batch}).encode()))
        out.close()
        return bool(self._fs.createNewFile(self._path(f"{self.folder}/commits/{number}-{batch}")))

    def write(self, notes: DataFrame, parent: int, tool: int | None = None, prompt: str | None = None) -> int:
        """The version that holds notes (path, content), written by someone who saw version `parent`. Paths that leave the folder, and a path that is given twice, are errors."""
        wrong = notes.where(~inside(F.col("path"))).limit(1).collect()
        if wrong:
            raise ValueError(f"a path leaves the folder: {wrong[0].path!r}")
        if not notes.groupBy("path").count().where("count > 1").isEmpty():
            raise ValueError("a path is given twice")
        batch = uuid.uuid4().hex
        before = self.read(parent).select("path", F.col("content").alias("content_before"))
        rows = notes.join(before, "path", "left").select("path", "content_before", F.col("content").alias("content_after"), F.lit(tool).cast("long").alias("tool"), F.lit(prompt).cast("string").alias("prompt"))
        rows.write.parquet(f"{self.folder}/batches/batch={batch}")
        seen, waited = parent, 0.0
        while True:
            last = self.last()
            if last > seen:
                if not self.versions(last, seen).join(notes.select("path"), "path", "left_semi").isEmpty():
                    raise Conflict(f"notes changed after version {seen}")
                seen, waited = last, 0.0
            if self._claim(seen + 1, batch):
                return seen + 1
            self._free(seen + 1)
            if self.last() == seen:  # claimed, but not even its batch is told yet
                if waited >= self.patience:
                    raise Conflict(f"version {seen + 1} was claimed by a writer that went away")
                time.sleep(0.2)
                waited += 0.2

    def _free(self, number: int) -> None:
        """Commits the batch that a claim names, in case its writer ended in between; it is whole by then, and the commit is the same file."""
        claim = self._path(f"{self.folder}/claims/{number}")
        try:
            found = self.spark.read.text(claim.toString()).first()
        except AnalysisException:
            return
        if found is not None:
            self._fs.createNewFile(self._path(f"{self.folder}/commits/{number}-{json.loads(found.value)['batch']}"))
