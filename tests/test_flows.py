"""Operators over transcripts, books, mail, links and notes on small cases; streams that stop and go on; two writers."""

import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.operators import alignment, attribution, books, geometry, mail, paragraphs, rewriting
from quillspark.plans.flows import CHAIN
from quillspark.sources import notes
from quillspark.streaming import steps


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# chunks in transcripts


def placed(spark, chunks, segments):
    s = spark.createDataFrame([(1, k, x) for k, x in enumerate(segments)], "d long, position long, text string")
    c = spark.createDataFrame([(1, k, x) for k, x in enumerate(chunks)], "d long, position long, text string")
    return [(r.first_segment, r.end_segment) for r in alignment.chunk_segments(s, c, "d").orderBy("chunk").collect()]


LONG = "To jest bardzo dlugi segment z wieloma slowami wypelniajacymi przestrzen tekstowa bez konca prawie."
PLACED = [
    ([], ["a"], []),
    (["a"], [], [(None, None)]),
    (["Ala ma kota"], ["Ala", "ma", "kota"], [(0, 3)]),
    ([f"Krotko. {LONG}", "Nowe zdanie. I konczy sie."], ["Krotko.", LONG, ">> Nowe zdanie.", "I konczy sie."], [(0, 2), (2, 4)]),
    (["Pierwsze zdanie tutaj jest. Drugie zdanie konczy fragment.", "Trzecie zdanie zaczyna."], ["Pierwsze zdanie tutaj jest.", "Drugie yyy zdanie konczy fragment.", "Trzecie zdanie zaczyna."], [(0, 2), (2, 3)]),
    (["nothing of this", "nor of that"], ["foo bar", "baz qux"], [(0, 1), (1, 2)]),
    (["", ""], ["a"], [(None, None), (None, None)]),
]


@pytest.mark.parametrize(("chunks", "segments", "want"), PLACED)
def test_chunks_in_segments(spark, chunks, segments, want):
    assert placed(spark, chunks, segments) == want


# cited sources

CITED = [
    ("Jak podaje agencja Bloomberg, powołując się na północnokoreańską państwową agencję KCNA, doszło do testów. NATO również wspomniano.", ["Bloomberg", "KCNA", "NATO"], {"Bloomberg": "bloomberg.com", "KCNA": "kcna.kp"}),
    ("Bloomberg otworzył nowe biuro.", ["Bloomberg"], {}),
    ("W komunikacie EDF poinformował, że doszło do wyłączeń - podają France24 oraz agencja AFP.", ["EDF", "France24", "AFP"], {"France24": None, "AFP": None}),
    ("AFP poinformowała o tym. Zaufanie AFPX rośnie.", ["AFP", "AFPX"], {"AFP": None}),
    ("Według (A+B) jest źle.", ["(A+B)"], {"(A+B)": None}),
    ("", ["AFP"], {}),
    (None, ["AFP"], {}),
]


@pytest.mark.parametrize(("text", "names", "want"), CITED)
def test_cited_sources(spark, text, names, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    organizations = spark.createDataFrame([(1, n, None) for n in names], "doc_id long, name string, variants array<string>")
    assert {r.source: r.domain for r in attribution.cited_sources(docs, organizations).collect()} == want


# links, brackets, corrections


def test_links_of_null_and_repeated_keys(spark):
    rows = [(None, "a http://x/1."), (None, "b http://x/2"), (1, "http://x/1 http://x/1)"), (1, "http://x/1 http://x/1)"), (2, None), (3, "http://x/9!")]
    docs = spark.createDataFrame(rows, "id long, text string")
    targets = spark.createDataFrame([("http://x/1", "http://one"), ("http://x/1", "http://uno"), ("http://x/2", "http://two")], "url string, target string")
    out = sorted(str(tuple(r)) for r in rewriting.rewrite_links(docs, targets, "id").collect())
    assert out == sorted(map(str, [(None, "a http://one."), (None, "b http://two"), (1, "http://one http://one)"), (1, "http://one http://one)"), (2, None), (3, "http://x/9!")]))


@pytest.mark.parametrize(("text", "want"), [("a\n[b\nc]\nd", "a\n[b c]\nd"), ("[\n\nx\n\n[y\n]\n]\n", "[x [y ] ]\n"), ("a]\n[b\n]c\n", "a]\n[b\n]c\n"), ("[open\nto the\nend", "[open to the end"), ("[![x](u)](v)[![y](w)](z)", "[![x](u)](v)\n\n[![y](w)](z)"), ("", ""), ("[ \n\nx]", "[ x]")])
def test_brackets(spark, text, want):
    assert value(spark, markup.brackets_in_one_line(F.lit(text))) == want


def test_own_corrections_first(spark):
    groups = spark.createDataFrame([(1, "Ann", "geogName", "Wisła", 2, ["Wiśle"], ["wisła"]), (1, None, "placeName", "Wisla", 1, None, None), (2, "Bob", "persName", "X", 1, [], [])], "doc long, author string, type string, text string, count long, variants array<string>, lemmas array<string>")
    rules = spark.createDataFrame([(1, "placeName", "WISŁA", "global", None, None, "Wisła (rzeka)"), (2, "*", "wisla", "author", "ann", "x", "Own")], "rule long, match_type string, lemma string, scope string, author string, new_type string, new_text string")
    for own, want in ((False, {(1, "geogName", "Wisła (rzeka)", 2), (1, "placeName", "Wisła (rzeka)", 1)}), (True, {(1, "x", "Own", 2), (1, "placeName", "Wisła (rzeka)", 1)})):
        after, audit = rewriting.apply_corrections(groups, rules, lambda df: df.persist(), own)
        assert {(r.doc, r.type, r.text, r["count"]) for r in after.collect()} == want | {(2, "persName", "X", 1)} and audit.count() == 2


# books


def test_book_with_chapters(spark):
    head = "POLSKA – POTENCJAŁ"
    body = "Zdanie pierwsze tej książki jest na tyle długie, aby strona kończyła się w środku zdania i"
    pages = [(1, 0, f"{head}\n\nWprowadzenie\n\n{body}\n\n12"), (1, 1, f"{head}\n\n biegło dalej"), (1, 2, f"{head}\r\n\r\n# Atom\r\n\r\nTekst.\n\n# Inny\n\nWPROWADZENIE\n\n13 "), (2, 0, "SAMA RAZ"), (2, 1, "tekst")]
    chapters = [(1, 0, "Wprowadzenie", None), (1, 1, "Energia — Atom", "Atom")]
    out = books.repair_books(spark.createDataFrame(pages, "book long, page long, text string"), spark.createDataFrame(chapters, "book long, turn int, title string, anchor string"))
    got = {r.book: r.text for r in out.collect()}
    assert got == {1: f"# Wprowadzenie\n\n{body}\n\n biegło dalej\n\n# Energia — Atom\n\nTekst.\n\n## Inny\n\nWPROWADZENIE\n", 2: "SAMA RAZ\ntekst\n"}


def test_repeated_capital_text_is_no_running_head(spark):
    """A text in capitals that repeats from page to page stays; what stands on top of the pages goes."""
    body = " ".join(["LOUD WORDS"] * 20)
    pages = [(1, k, f"\n{k + 1}\nHEAD OF ALL\n\n{body}\n") for k in range(4)]
    out = books.repair_books(spark.createDataFrame(pages, "book long, page long, text string"))
    assert [r.text for r in out.collect()] == ["\n\n".join([body] * 4) + "\n"]


def test_paragraphs_over_pages(spark):
    long = "a" * 90
    text = f"{long}\n\nbegan\n\n# {long}\n\nlower\n\n{long}.\n\nlower\n\n{long},\n\nUpper"
    assert value(spark, books.join_paragraphs(F.lit(text))) == f"{long} began\n\n# {long}\n\nlower\n\n{long}.\n\nlower\n\n{long},\n\nUpper"


# steps


def test_chain_folds_alike(spark):
    import random

    r = random.Random(2)
    rows = [(k, [r.choice(["ensure", "done", "done", "failed", "stale", "odd"]) for _ in range(r.randint(0, 14))]) for k in range(120)]
    out = spark.createDataFrame(rows, "k long, e array<string>").select("k", CHAIN.folded(F.col("e")).alias("s"))
    got = {x.k: tuple(x.s) for x in out.collect()}
    for k, events in rows:
        s = (0, "", 0)
        for e in events:
            s = CHAIN.after(*s, e)
        assert got[k] == s


def test_steps_stop_and_go_on(spark, tmp_path):
    """A query that ends after half of the events goes on from its checkpoint; a silent step is recovered by its timer."""
    spark.conf.set(steps.STORE, steps.ROCKS)
    day = datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(hours=h)
    first = [(1, "ensure", at(0)), (1, "done", at(1)), (2, "ensure", at(0)), (2, "failed", at(0.5)), (3, "ensure", at(0)), (3, "done", at(0.2)), (3, "done", at(0.2))]
    second = [(1, "done", at(1.5)), (2, "failed", at(1.1)), (2, "done", at(1.2)), (2, "ensure", at(1.4))]
    third = [(9, "ensure", at(12))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, "key long, event string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key long, event string, at timestamp").parquet(source)
        q = steps.step_changes(stream, CHAIN, "3 hours", "0 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(180)

    try:
        for rows in (first, second, third):
            run(rows)
    finally:
        spark.conf.unset(steps.STORE)
    changes = sorted(tuple(r) for r in spark.read.parquet(out).select("key", "at", "event", "step", "status", "attempt").collect())
    last = {}
    for key, _, event, *state in changes:
        last.setdefault(key, []).append((event, *state))
    assert [e for e in last[2]] == [("ensure", 0, "waiting", 0), ("failed", 0, "waiting", 1), ("failed", 0, "failed", 2), ("ensure", 0, "waiting", 0), ("stale", 0, "waiting", 1), ("stale", 0, "failed", 2)]
    assert last[1][:3] == [("ensure", 0, "waiting", 0), ("done", 1, "waiting", 0), ("done", 2, "waiting", 0)] and last[1][3:] == [("stale", 2, "waiting", 1), ("stale", 2, "failed", 2)]
    assert last[3][:3] == [("ensure", 0, "waiting", 0), ("done", 1, "waiting", 0), ("done", 2, "waiting", 0)]


# notes


def note_rows(spark, **content):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in content.items()], "path string, content string")


def test_two_writers(spark, tmp_path):
    store, other = notes.NoteStore(spark, str(tmp_path / "vault")), notes.NoteStore(spark, str(tmp_path / "vault"))
    assert store.read().count() == 0 and store.last() == 0
    assert store.write(note_rows(spark, a="1", b="1"), 0, tool=7, prompt="make") == 1
    assert store.write(note_rows(spark, a="2"), 1) == 2
    # began from version 1: the same note loses, another one goes on behind
    with pytest.raises(notes.Conflict):
        other.write(note_rows(spark, a="other"), 1)
    assert other.write(note_rows(spark, b="2", c="1"), 1) == 3
    assert {r.path: (r.content, r.version) for r in other.read().collect()} == {"a.md": ("2", 2), "b.md": ("2", 3), "c.md": ("1", 3)}
    assert {r.path: r.content for r in other.read(1).collect()} == {"a.md": "1", "b.md": "1"}
    told = {(r.path, r.version): (r.content_before, r.content_after, r.tool, r.prompt) for r in store.versions().collect()}
    assert told["b.md", 3] == ("1", "2", None, None) and told["a.md", 1] == (None, "1", 7, "make") and len(told) == 5


def test_half_a_version_is_never_seen(spark, tmp_path):
    store = notes.NoteStore(spark, str(tmp_path / "vault"), patience=0.3)
    store.write(note_rows(spark, a="1"), 0)
    # a writer that ended before its claim: a batch without commit
    spark.createDataFrame([("a.md", None, "lost", None, None)], notes.SCHEMA).write.parquet(f"{store.folder}/batches/batch=dead")
    assert [r.content for r in store.read().collect()] == ["1"]
    # one that ended between its claim and its commit: the next writer commits it, and then goes on behind it
    spark.createDataFrame([("z.md", None, "late", None, None)], notes.SCHEMA).write.parquet(f"{store.folder}/batches/batch=late")
    (tmp_path / "vault" / "claims" / "2").write_text('{"batch": "late"}')
    assert store.write(note_rows(spark, a="2"), 1) == 3
    assert {r.path: r.content for r in store.read().collect()} == {"a.md": "2", "z.md": "late"}
    # one that ended while it claimed
    (tmp_path / "vault" / "claims" / "4").write_text("")
    with pytest.raises(notes.Conflict, match="went away"):
        store.write(note_rows(spark, a="3"), 3)
    assert store.last() == 3


@pytest.mark.parametrize("path", ["../x", "/x", "a/../../x", "", "a/..", None])
def test_paths_that_leave(spark, tmp_path, path):
    with pytest.raises(ValueError, match="leaves"):
        notes.NoteStore(spark, str(tmp_path / "vault")).write(spark.createDataFrame([(path, "x")], "path string, content string"), 0)


# mail, paragraphs, places


def test_mail_bodies(spark):
    assert [value(spark, mail.body_text(F.lit(x))) for x in ("xbzDs8WCxIc", "xbzDs8WCxIc=", "_w==", "a b!", None)] == ["żółć", "żółć", "�", None, None]
    deep = '{"mimeType":"text/plain","body":{"data":"eA"}}'
    for _ in range(9):
        deep = f'{{"mimeType":"m","parts":[{{"mimeType":"text/html"}},{deep}]}}'
    mails = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, '{"parts": 5}')], "id long, payload string")
    (row,) = mail.body_parts(mails, "text/plain").collect()
    assert (row.id, row.place, row.text) == (1, [1] * 9, "x")
    with pytest.raises(ValueError, match="deeper"):
        mail.body_parts(mails, "text/plain", most_depth=3)
    assert value(spark, mail.header(F.parse_json(F.lit('{"headers":[{"name":"SUBJECT","value":"a"},{"name":"Subject","value":"b"}]}')), "Subject")) == "a"


def test_paragraphs_for_any_window(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")

    def propose(windows):
        """A sentence of an even length ends a paragraph, and what a window can't know is noise."""
        even = windows.select("key", "window", F.explode(F.filter("sentences", lambda s: F.length(s["sentence"]) % 2 == 0)).alias("s")).select("key", "window", F.col("s.at").alias("after"))
        noise = windows.select("key", "window", F.explode(F.array(F.element_at("sentences", -1)["at"], F.element_at("sentences", -1)["at"] + 5)).alias("after"))
        return even.unionByName(noise)

    results = [{r.doc_id: (r.text, r.n_paragraphs) for r in paragraphs.paragraphs(docs, propose, size, step).collect()} for size, step in ((12, 6), (5, 2), (40, 3))]
    assert results[0] == results[1] == results[2] and any(n > 3 for _, n in results[0].values())
    squeeze = lambda x: "".join((x or "").split())
    assert all(squeeze(results[0][r.doc_id][0]) == squeeze(r.text) for r in docs.collect())


def test_places_near_lines_without_cross_join(spark):
    points = spark.createDataFrame([(1, 52.0, 21.0), (2, 52.0, 179.9), (3, 89.5, 10.0), (4, 91.0, 0.0), (5, None, 0.0)], "id long, lat double, lon double").select("id", geometry.point(F.col("lat"), F.col("lon")).alias("point"))
    lines = spark.createDataFrame([(1, [(52.5, 20.0), (52.5, 22.0)]), (2, [(89.0, -170.0), (89.0, 170.0)]), (3, [(52.0, 21.0)]), (4, [])], "line long, points array<struct<lat double, lon double>>")
    out = geometry.near_lines(points, lines, 60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sorted((r.id, r.line, round(r.km)) for r in out.collect()) == [(1, 1, 56), (1, 3, 0), (3, 2, 56)]


def test_cells_follow_lines(spark):
    """A slanting line takes cells along it, not its box; what is near by brute force is found, next to the poles too."""
    import math

    lines = {1: [(-60.0, -170.0), (65.0, 160.0)], 2: [(89.0, -170.0), (89.0, -150.0)], 3: [(10.0, 5.0), (10.0, 9.0)], 4: [(-89.9, 0.0), (-70.0, 1.0)], 5: [(40.0, 20.0), (-30.0, 20.0)]}
    frame = spark.createDataFrame(list(lines.items()), "line long, points array<struct<lat double, lon double>>")
    cells = {r.line: r["count"] for r in geometry.line_cells(frame, 150, 1.0).groupBy("line").count().collect()}
    assert cells[1] < 2500  # the box has over 40,000
    points = [((k * 7919 % 18000) / 100 - 90, (k * 104729 % 36000) / 100 - 180) for k in range(6000)] + [(89.95, 120.0), (-89.99, 179.0), (-90.0, -90.0), (10.0, 7.0)]

    def km(p, a, b):
        s = math.cos(math.radians(p[0]))
        ax, ay, bx, by = (a[1] - p[1]) * s, a[0] - p[0], (b[1] - p[1]) * s, b[0] - p[0]
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1.0, max(0.0, -(ax * (bx - ax) + ay * (by - ay)) / n)) if n > 0 else 0.0
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay)) * geometry.DEGREE_KM

    want = {(i, line) for i, p in enumerate(points) for line, (a, b) in lines.items() if km(p, a, b) <= 150}
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lon double").select("id", geometry.point(F.col("lat"), F.col("lon")).alias("point"))
    assert {(r.id, r.line) for r in geometry.near_lines(asked, frame, 150).collect()} == want and (6000, 2) in want


# files, filters


def test_files_of_rules_and_usage(spark, tmp_path):
    from quillspark.operators.sites import clean_pages, site_rules
    from quillspark.sources import catalog

    for name, text in (("a/x/1.txt", "12345"), ("a/2.txt", "67"), ("b/3.txt", "8"), ("4.txt", "0"), ("rules.json", '{"e.com": {"remove_before": ["BEGIN"], "remove_string": ["ad"]}, "_global": {"remove_after": ["END"]}}'), ("patterns.txt", "# no\na+b\r\n\n  #x\n c\n")):
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = str(tmp_path / "files")
    used = {r.folder: (r.files, r.bytes) for r in catalog.folder_usage(spark, root).collect()}
    assert used["a"] == (2, 7) and used["b"] == (1, 1) and used[""][0] == 3
    assert {r.folder for r in catalog.folder_usage(spark, root, 2).collect()} == {"a/x", "a", "b", ""}
    assert catalog.pattern_lines(spark, f"{root}/patterns.txt") == ["a+b", " c"] and catalog.rules_file(spark, f"{root}/none.json") == {}
    pages = spark.createDataFrame([("https://e.com/1", "x BEGIN ad text END y"), ("https://f.org", "BEGIN z END")], "url string, text string")
    assert sorted(r.text.strip() for r in clean_pages(pages, site_rules(catalog.rules_file(spark, f"{root}/rules.json"))).collect()) == ["BEGIN z", "text"]
    with pytest.raises(TypeError):
        site_rules({"e.com": {"unknown": []}})


FIELDS = {
    "publisher_name": ("łódź PRESS", {1, 2}),
    "publisher_domain": ("http://www.A.com/x", {1, 4}),
    "discovery_source": ("Nobody", set()),
    "collection": ("main", {2, 3}),
    "author_name": ("ZOE", {1, 3}),
    "published_from": (datetime.date(2024, 1, 2), {2, 3}),
    "published_to": (datetime.date(2024, 1, 2), {1, 2}),
    "ingested_from": (datetime.datetime(2024, 1, 2), {2}),
    "ingested_to": (datetime.datetime(2024, 1, 1, 23), {1}),
    "period_start": (1950, {1, 3}),
    "period_end": (1900, {1, 2}),
    "document_types": (("note",), {2}),
    "languages": (("pl", "en"), {1, 2, 4}),
    "without_embedding": (True, {2, 3, 4}),
    "source_layer": ("managed", {1, 3, 4}),
}


@pytest.mark.parametrize("field", FIELDS)
def test_each_filter(spark, field):
    from dataclasses import fields

    from quillspark.operators.filters import SearchFilters, apply_filters

    assert {f.name for f in fields(SearchFilters)} == set(FIELDS)
    day, at = datetime.date, datetime.datetime
    docs = spark.createDataFrame(
        [(1, 10, 1, 1, "x", "pl", day(2024, 1, 1), at(2024, 1, 1), "by nobody"), (2, 20, 1, 2, "note", "en", day(2024, 1, 2), at(2024, 1, 3), "zoe"), (3, 30, 2, 2, "x", "de", day(2024, 1, 3), None, "with Zoé and others"), (4, 10, None, None, "x", "pl", None, None, None)],
        "id long, publisher_id long, discovery_source_id long, collection_id long, document_type string, language string, published_on date, ingested_at timestamp, byline string",
    ).withColumn("publisher_id", F.when(F.col("id") == 4, 40).otherwise(F.col("publisher_id")))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = apply_filters(
        docs,
        SearchFilters(**{field: FIELDS[field][0]}),
        authors=table([(1, 7, "Zoë"), (2, 8, "Eva")], "document_id long, person_id long, name string"),
        aliases=table([(8, "Evita")], "person_id long, alias string"),
        periods=table([(1, None, None), (2, 1800, 1900), (3, 1940, None)], "document_id long, start_year int, end_year int"),
        embeddings=table([(1,)], "document_id long"),
        publishers=table([(10, "Lodz Press"), (20, "ŁÓDŹ  press"), (30, "Other")], "id long, name string"),
        publisher_domains=table([(10, "A.com"), (40, "a.com"), (30, "b.com")], "publisher_id long, domain string"),
        discovery_sources=table([(1, "Feed")], "id long, name string"),
        collections=table([(1, "Main"), (2, "main")], "id long, name string"),
    )
    assert {r.id for r in out.collect()} == FIELDS[field][1]
