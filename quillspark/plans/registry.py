"""Registered queries, each with SQL that DuckDB runs on the same tables where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("listing", "joins", "reports", "ranking", "text", "web", "chunks", "dates", "markup", "articles", "portal", "search", "entities", "incremental", "feeds", "review", "mutations", "places", "answers", "workflow", "repairs", "flows", "references")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers build(t), where t(name) is a table, under the function's name."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _queries[build.__name__] = run
        if sql:
            _sql[build.__name__] = sql
        return build

    return register


def literal(x) -> str:
    """A value as an SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def rows_sql(rows: list[tuple], names: str) -> str:
    """SQL of the rows themselves: what a query over inline cases must give."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({names})"


def inline(t, rows: list[tuple], schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(rows, schema)


def _mark() -> Column:
    return F.concat(F.coalesce("lang", F.lit("xx")), "doc_id")


def shaped(t, cases: list[tuple], schema: str) -> DataFrame:
    """All documents, each with the case that its number chooses: doc_id, shape and the case's columns, in whose strings {} is the document's own mark."""
    kinds = inline(t, [(k, *c) for k, c in enumerate(cases)], f"shape int, {schema}")
    rows = t("documents").select("doc_id", _mark().alias("mark"), F.pmod("doc_id", F.lit(len(cases))).cast("int").alias("shape"))
    put = lambda c: F.replace(c, F.lit("{}"), F.col("mark"))
    told = {"string": lambda c: put(F.col(c)), "array<string>": lambda c: F.transform(c, put)}
    return rows.join(F.broadcast(kinds), "shape").select("doc_id", "shape", *[told.get(kind, F.col)(c).alias(c) for c, kind in kinds.dtypes if c != "shape"])


def shaped_sql(rows: list[tuple], names: str, n: int | None = None) -> str:
    """SQL of what a query over shaped documents must give: rows of (expected columns), a shape each; with n given, rows of (shape, expected columns) for n shapes."""
    if n is None:
        rows, n = [(k, *r) for k, r in enumerate(rows)], len(rows)
    names = [x.strip() for x in names.split(",")]
    text = lambda i: any(isinstance(r[i + 1], str) for r in rows)
    told = [f"replace({c}, '{{}}', coalesce(lang, 'xx') || doc_id) AS {c}" if text(i) else c for i, c in enumerate(names)]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT doc_id, {', '.join(told)} FROM (SELECT doc_id, lang FROM documents) JOIN (VALUES {values}) v(shape, {', '.join(names)}) ON doc_id % {n} = shape"


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quillspark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
