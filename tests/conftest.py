import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set enable_progress_bar = false")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(df):
    """A frame's rows as sorted tuples of plain values, columns in order of name."""
    import math

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 9))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(query, sql):
        ours, theirs = query(spark, SMALL).toPandas(), duck.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)

    return check
