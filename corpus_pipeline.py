"""A corpus from raw documents to a mix: each stage calls one operator and hands its documents to the next.

Extra columns pass through; one that has the name of an operator's result comes out with that result. Null text counts as
empty. Repeated rows are judged alike until near-duplicate removal keeps one of them. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import column, shared_folder, table
from quillspark.llm.decontaminate import find_benchmark
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.mixing import mix_sources
from quillspark.llm.near_copies import first_of_near_copies
from quillspark.llm.quality_rules import quality_rules


def with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """docs with another text, and n_chars brought in line where there is such a column."""
    new = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else column(docs, c).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a rule."""
    return with_text(quality_rules(docs).where("kept"), docs.columns, "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them. All documents stay."""
    return with_text(dedup_lines(docs), docs.columns, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays: the one of the smallest id."""
    found = first_of_near_copies(docs)
    return found.select(*[column(found, c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go."""
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated")
    return found.select(*[column(found, c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with how many (taken) and how often whole (epochs)."""
    return mix_sources(docs).where("taken > 0")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix)]

#: Components over exact shingle similarity are out of DuckDB SQL's reach here; tests run a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again by the next."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
