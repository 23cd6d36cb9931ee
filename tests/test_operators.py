"""Relational, entity, incremental and model operators; plans; streams."""

import datetime
import random

from pyspark.sql import functions as F

from quillspark.operators import entities, incremental, models, relational
from quillspark.operators.filters import SearchFilters, apply_filters
from quillspark.sources.catalog import Catalog, objects, whole_texts
from quillspark.streaming import feeds, jobs

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    docs = Catalog(spark, SMALL).table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    text = plan(apply_filters(docs, SearchFilters(languages=("en",))))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_top_k_and_semi_joins(spark):
    cat = Catalog(spark, SMALL)
    assert "TakeOrderedAndProject" in plan(relational.page(cat.table("documents").select("doc_id"), [F.desc("doc_id")]))
    docs, have = cat.table("documents").select(F.col("doc_id").alias("id")), cat.table("embeddings").select(F.col("vec_id").alias("document_id"))
    assert "LeftAnti" in plan(apply_filters(docs, SearchFilters(without_embedding=True), embeddings=have))


def test_pages():
    assert [relational.page_count(n, 50) for n in (0, 50, 51)] == [1, 1, 2] and relational.page_count(1000, 1000) == 10


def test_effective_prices(spark):
    facts = spark.sql("select * from values ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-05'), ('b', timestamp'2024-01-01') t(k, at)")
    prices = spark.sql("select * from values ('a', timestamp'2024-01-01', timestamp'2024-01-05', 1), ('a', timestamp'2024-01-05', null, 2) t(k, effective_from, effective_to, rate)")
    assert sorted((r.k, r.rate) for r in relational.effective_at(facts, "at", prices, ["k"]).collect() if r.rate) == [("a", 1), ("a", 2)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    found = {r["node"]: r["root"] for r in relational.connected(edges, lambda d: d.checkpoint()).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and found[101] == 100 and found[200] == 200


def test_resolution(spark):
    names = spark.createDataFrame([(1, "Jan Nowak"), (2, "Ewa Żak")], "entity_id int, name string")
    aliases = spark.createDataFrame([(1, "J. Nowak"), (2, "J. Nowak")], "entity_id int, name string")
    asked = spark.createDataFrame([(1, "jan  NOWAK"), (2, "j. nowak"), (3, "ewa zak"), (4, "?")], "id int, name string")
    found = {r["id"]: (r["entity_id"], r["status"]) for r in entities.resolve(asked, entities.alias_index(names, aliases)).collect()}
    assert found == {1: (1, "resolved"), 2: (None, "ambiguous"), 3: (2, "resolved"), 4: (None, "unknown")}


def test_most_similar_tells_numbers_of_the_same_trigrams(spark, tmp_path):
    """Customer 1000 isn't supplier 100, though both numbers have the same trigrams; the order of words doesn't matter."""
    import duckdb
    from quillspark.plans import registry

    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in (100, 222, 1000, 2222, 3000)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in (100, 222, 300)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["similar_tool"]).fetchall()
    assert sorted(map(str, map(tuple, registry.queries()["similar_tool"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [tuple(r) for r in entities.most_similar(names("Studio, visual", "else"), names("Visual Studio", "Visual"), 0.9).collect()] == [("Studio, visual", "Visual Studio")]


def test_names_in_long_texts(spark):
    """Marks, runs that overlap, words cut by other signs; a text of 40,000 different words takes no time that grows with their square."""
    import time

    from quillspark.functions import places as P
    from quillspark.operators.places import names_in

    texts = ["Sudanie  Południowym", "Sudan. Południowy", "KOREĄ-\nPÓŁNOCNĄ", "do Polski,Ukrainy", "xpolska polskaé", "rpax RPA", "Nowa Zelandia", "papua nowa gwinea bissau", "õpolska", "_polska polska_", None, ""]
    want = {0: {"Sudan", "Sudan Południowy"}, 1: {"Sudan"}, 2: {"Korea Północna"}, 3: {"Polska", "Ukraina"}, 4: {"Polska"}, 5: {"Republika Południowej Afryki"}, 6: {"Nowa Zelandia"}, 7: {"Papua-Nowa Gwinea", "Gwinea Bissau"}, 8: {"Polska"}, 9: {"Polska"}, 100: {"Polska"}}
    rows = [*enumerate(texts), (100, " ".join(f"w{k}x" for k in range(40_000)) + " Polską")]
    start, found = time.perf_counter(), {}
    for r in names_in(spark.createDataFrame(rows, "id long, text string"), P.COUNTRIES).collect():
        found.setdefault(r.id, set()).add(r.name)
    assert time.perf_counter() - start < 30
    assert {k: v - {"Gwinea"} for k, v in found.items()} == want


def test_similar_names_equals_brute_force(spark):
    names = ["anna nowak", "ana nowak", "jan kowalski", "jan kowalsky", "kowal", "", "x"]
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    want = {(a, b) for a in names for b in names if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {(r["name"], r["other"]) for r in entities.similar_names(df, df, 0.5).collect()} == want


def test_similar_names_of_any_threshold(spark):
    """Thresholds from keys of single trigrams to whole sets; 0.56 * 25 is above 14 in doubles, yet 14 of 25 reach 0.56."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdx") for _ in range(rnd.choice([1, 2, 5, 9, 14])))
    some = [word() for _ in range(12)]
    names = {" ".join(rnd.choices(some, k=rnd.choice([1, 2, 4, 6]))) for _ in range(40)}
    left = sorted(names | {"abcdefghijklm nopqrstuvw", "", "-"})
    right = sorted({n[: (k := rnd.randrange(len(n)))] + rnd.choice(["", "b", " "]) + n[k:] for n in names} | set(left[:9]) | {"abcdefghijklm", "  "})
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.replace("-", " ").split() for i in range(len(w) + 1)}
    a, b = (spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right))
    for least in (0.5, 0.56, 0.8, 0.9, 0.95):
        want = {(x, y) for x in left for y in right if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= least}
        assert sorted((r["name"], r["other"]) for r in entities.similar_names(a, b, least).collect()) == sorted(want), least


def test_names_compared_grow_with_the_names(spark):
    """Numbered names, whose trigrams all stand in many of them, are compared with few others, and none is sent through the driver."""
    for first in (0, 123_456_000):
        names = spark.range(first, first + 4000).select(F.format_string("Supplier#%09d", "id").alias("name"))
        assert "Broadcast" not in plan(entities.similar_names(names, names, 0.95))
        assert 4000 <= entities.sharing_names(names, names, 0.95).distinct().count() < 3 * 4000


def test_recover_and_claim(spark):
    now = F.lit(datetime.datetime(2024, 1, 1, 12))
    old, new = datetime.datetime(2024, 1, 1, 11), datetime.datetime(2024, 1, 1, 11, 59)
    rows = [(1, "t", "running", 1, 3, old, old), (2, "t", "running", 3, 3, old, old), (3, "t", "running", 1, 3, old, new), (4, "t", "queued", 0, 3, old, old)]
    df = spark.createDataFrame(rows, "id int, type string, status string, attempt int, max_attempts int, available_at timestamp, heartbeat_at timestamp")
    found = {r["id"]: (r["status"], r["available_at"]) for r in incremental.recover(df, now).collect()}
    assert [found[i][0] for i in (1, 2, 3, 4)] == ["queued", "failed", "running", "queued"]
    assert found[1][1] == datetime.datetime(2024, 1, 1, 12, 0, 30)
    assert [r["id"] for r in incremental.claim(df, now, ["t"], 5).collect()] == [4]


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "bad")], "id int, t string")

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [len(t) for t in texts]

    found = {r["id"]: (r["result"], r["error"]) for r in models.call_model(df, "id", "t", model, "long").collect()}
    assert found == {1: (3, None), 2: (0, None), 3: (None, "ValueError: no")}
    assert models.embed(df, "id", "t").count() == 3 and models.hashed_embedding("x y") == models.hashed_embedding("y x")
    assert models.capital_tags("seen in New York by Ann") == ["New York", "Ann"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "b.bin").write_bytes(b"12")
    assert {r["key"]: r["length"] for r in objects(spark, str(tmp_path)).collect()} == {"a.md": 5, "b.bin": 2}
    assert whole_texts(spark, str(tmp_path / "a.md")).first()["text"] == "# A\nx"


def test_job_states():
    assert jobs.follow("new", 0, ["enqueue", "claim", "finish", "claim"]) == ("done", 1)
    assert jobs.follow("new", 0, ["enqueue", "claim", "stale", "claim", "stale", "claim", "stale"]) == ("failed", 3)


def event_stream(spark, tmp_path, schema="event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"):
    src = tmp_path / "in"
    src.mkdir()
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.mode("append").parquet(str(src))
    stream = feeds.read_files(spark, str(src), schema, 1)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_windows_equal_batch(spark, tmp_path):
    stream = feeds.windowed_counts(event_stream(spark, tmp_path), "ts", "event_type", "1 day", "40 days")
    found = finished(stream, "win", "update", tmp_path).groupBy("start", "event_type").agg(F.max("n").alias("n"))
    batch = spark.read.parquet(f"{SMALL}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_upsert_equals_batch(spark, tmp_path):
    q = feeds.upsert_table(event_stream(spark, tmp_path).select("user_id", "ts", "event_id"), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"], "ts")
    q.awaitTermination(120)
    found = feeds.read_table(spark, str(tmp_path / "out"))
    batch = spark.read.parquet(f"{SMALL}/events.parquet").groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    assert sorted(map(tuple, found.select("user_id", "event_id").collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    """A second run with one key leaves the other buckets where they stand; a batch that fails before its log doesn't count."""
    out, schema = str(tmp_path / "out"), "id long, at long, v string"

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = feeds.upsert_table(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp"), ["id"], "at", buckets=4)
        assert q.awaitTermination(120)

    feed([(i, 1, "old") for i in range(40)])
    before = feeds.current_paths(spark, out)
    feed([(3, 2, "new"), (3, 1, "late"), (5, 0, "older")])
    after = feeds.current_paths(spark, out)
    moved = [b for b in after if after[b] != before[b]]
    assert len(before) == 4 and 1 <= len(moved) <= 2
    assert sorted(map(tuple, feeds.read_table(spark, out).select("id", "v").collect())) == [(i, "new" if i == 3 else "old") for i in range(40)]


def test_stream_once_per_key(spark, tmp_path):
    found = finished(feeds.once_per_key(event_stream(spark, tmp_path), ["user_id"], "ts", "60 days").select("user_id"), "once", "append", tmp_path)
    assert found.count() == found.distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()


def test_stream_job_states(spark, tmp_path):
    kinds = F.element_at(F.create_map(F.lit("click"), F.lit("enqueue"), F.lit("view"), F.lit("claim"), F.lit("error"), F.lit("fail")), F.col("event_type"))
    events = event_stream(spark, tmp_path).select(F.col("user_id").alias("job_id"), F.coalesce(kinds, F.lit("finish")).alias("event"), F.col("ts").alias("at"))
    found = finished(jobs.job_states(events), "states", "update", tmp_path)
    assert found.count() > 0 and set(r["state"] for r in found.select("state").distinct().collect()) <= set(jobs.NEXT.values()) | {"new"}


def test_feed_merge(spark):
    old = spark.createDataFrame([], "feed string, key string, title string, first_seen timestamp, last_seen timestamp")
    t1, t2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    batch = spark.createDataFrame([("f", "https://e.com/a?utm_x=1", "old", t1), ("f", "https://E.com/a/", "new", t2)], "feed string, url string, title string, seen_at timestamp")
    (row,) = feeds.merge_entries(old, batch).collect()
    assert tuple(row) == ("f", "https://e.com/a", "new", t1, t2)


def test_components_of_chains_stars_and_loops(spark, tmp_path):
    import random

    from quillspark.operators.relational import connected

    r = random.Random(4)
    chain = list(range(200))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(1, 80)] + [(5000, 5000), (1001, 1001), (6001, 6000), (6000, 6001)] + [(7000 + r.randint(0, 40), 7000 + r.randint(0, 40)) for _ in range(45)]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    found = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a long, b long"), lambda df: df.checkpoint()).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert found == {n: find(n) for n in root}


def test_neighbours_keep_rows_without_key(spark):
    from quillspark.operators.relational import neighbours

    out = neighbours(spark.createDataFrame([(1,), (5,), (None,), (12,)], "id long"), "id", 4)
    assert {(r.id, r.previous_id, r.next_id) for r in out.collect()} == {(1, None, 5), (5, 1, 12), (12, 5, None), (None, None, None)}


def test_searching_unfolded_texts(spark):
    """What a pattern finds in a text is what its folded form holds."""
    from quillspark.functions.text import unaccent
    from quillspark.operators import search

    texts = ["Élan POUR", "elan", "ÉLÀŃ", "straße STRASSE", "Łódź", "lodz", "KİTE", "\u212aelvin", "a.b axb", ""]
    for token in ("elan", "pour", "lodz", "a.b", "kelvin", "kit", "stra"):
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select(F.col("x").rlike(search.folded_pattern(token)).alias("p"), F.contains(F.lower(unaccent(F.col("x"))), F.lit(token)).alias("f"))
        assert all(r.p == r.f for r in rows.collect()), token
