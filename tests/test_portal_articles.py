"""Sections of portal articles against a plain loop, hard rows of article cleaning, and its plan."""

import random

from pyspark.sql import functions as F

from quillspark.functions import site_lines as S
from quillspark.operators.articles import clean_articles


def by_loop(lines, opens, inside, last, backward):
    out, on = [], False
    for x in reversed(lines) if backward else lines:
        if x == opens:
            on = True
        elif on and x == last:
            on = False
            continue
        elif on and x in inside:
            if not (backward and x == ""):
                continue
        else:
            on = False
        if x == opens:
            continue
        out.append(x)
    return out[::-1] if backward else out


def test_sections_by_loop(spark):
    rng = random.Random(3)
    texts = [[rng.choice(["O", "I", "E", "x", ""]) for _ in range(rng.randrange(1, 30))] for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, lines array<string>")
    for backward in (False, True):
        s = S.Section(lambda x: x == "O", lambda x: x.isin("I", ""), lambda x: x == "E", backward)
        found = dict(df.select("k", S._without_section(F.col("lines"), s)).collect())
        for k, t in enumerate(texts):
            assert found[k] == by_loop(t, "O", ("I", ""), "E", backward), t


def test_hard_rows(spark):
    rows = [(1, None, None, "a"), (2, "", "https://wp.pl", "b"), (3, "Skomentuj\n" + "słowo kolejne\n" * 20_000 + "koniec", "https://wp.pl", "c"), (3, "x", "no address", None)]
    df = spark.createDataFrame(rows, "id int, text string, url string, portal string").withColumn("article", F.lit(0))
    out = clean_articles(df, "text", "url")
    assert out.columns == ["id", "text", "url", "portal", "article"]
    got = sorted((r.id, r.portal or "", len(r.article.text)) for r in out.collect())
    assert got == [(1, "a", 0), (2, "b", 0), (3, "", 1), (3, "c", 20_000 * 14 + 6)]
    assert clean_articles(df.limit(0), "text", "url").count() == 0


def test_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = clean_articles(df.select("page_id", "html", "url"), "html", "url")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
