"""Scanned books: pages put together, headings found, printed contents linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chapters
from ..functions.text import SPACE_CHARS, let, strip

#: Typographic marks and their plain forms, in order.
DASHES, QUOTES = "–—", "„”“"
LETTER, CONTENTS = "a-ząćęłńóśźż", "spis tre[śs]ci"


def title_key(line: Column) -> Column:
    """A title for comparison: no heading marks, plain dashes, quotes and dots, lower case, spaces and dashes as one space."""
    plain = F.regexp_replace(F.regexp_replace(F.btrim(line), r"^#{1,6}\s+", ""), r"#+$", "")
    plain = F.replace(F.translate(F.btrim(plain), DASHES + QUOTES, "-" * len(DASHES) + '"' * len(QUOTES)), F.lit("…"), F.lit("..."))
    return F.lower(F.regexp_replace(plain, r"[\s-]+", " "))


def is_number(line: Column) -> Column:
    """A page number alone."""
    return F.btrim(line).rlike(r"^\d{1,4}$")


def page_lines(pages: DataFrame) -> DataFrame:
    """(book, page, line, text, top) of pages (book, page, text); top: whether it is the page's first line but for blank ones and page numbers."""
    split = pages.select("book", "page", F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"))
    first = F.array_position(F.transform("lines", lambda x: x.rlike(r"\S") & ~is_number(x)), F.lit(True)) - 1
    return split.select("book", "page", first.alias("first"), F.posexplode("lines").alias("line", "text")).select("book", "page", "line", "text", (F.col("line") == F.col("first")).alias("top"))


def is_capitals(line: Column) -> Column:
    """Letters, and all of them capital."""
    return line.rlike(r"(?U)\p{L}") & ~line.rlike(r"(?U)\p{Ll}") & ~F.startswith(F.btrim(line), F.lit("#"))


def without_running_heads(lines: DataFrame, least_pages: int = 3) -> DataFrame:
    """lines without page numbers and without the running heads: capital lines that stand on top of at least least_pages pages of their book.

    Capital lines that repeat further down are text. Pages are counted over the whole corpus, pages of a line first, so a head of
    every page is spread over tasks.
    """
    rest = lines.where(~is_number(F.col("text"))).withColumns({"capital": is_capitals(F.col("text")), "key": F.xxhash64(title_key(F.col("text")))})
    heads = rest.where("capital AND top").select("book", "page", "key").distinct().groupBy("book", "key").count().where(F.col("count") >= least_pages).select("book", "key", F.lit(True).alias("head"))
    marked = rest.join(heads, ["book", "key"], "left")
    return marked.where(~(F.col("capital") & F.col("head").isNotNull())).select("book", "page", "line", "text")


def in_order(found: Column, wanted: Column) -> Column:
    """The places (line numbers) at which the wanted titles stand one after another: each at its first place after the one before. found: array of struct(at, key), sorted."""
    step = lambda s, x: F.when(x["key"] == F.get(wanted, F.size(s)), F.concat(s, F.array(x["at"]))).otherwise(s)
    return F.aggregate(found, F.array().cast("array<long>"), step)


def with_chapters(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """lines (book, at, text) with the chapters' titles as first-level headings where their anchors stand, in order; other first-level headings go down one level.

    chapters: book, turn, title, anchor (null: the title). A chapter whose anchor isn't found after the one before stays out, and so do those after it.
    """
    wanted = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("turn", title_key(F.coalesce("anchor", "title")).alias("key"), "title"))).alias("wanted"))
    keyed = lines.withColumn("key", title_key(F.col("text")))
    possible = keyed.join(wanted.select("book", F.explode(F.array_distinct(F.col("wanted.key"))).alias("key")), ["book", "key"])
    places = possible.where(F.btrim("text") != "").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("found")).join(wanted, "book")
    placed = places.select("book", F.posexplode(in_order(F.col("found"), F.col("wanted.key"))).alias("n", "at"), "wanted").select("book", "at", F.get("wanted.title", F.col("n")).alias("title"))
    lower = F.regexp_replace("text", r"^\s*#\s+(.*?)\s*$", "## $1")
    return keyed.join(placed, ["book", "at"], "left").select("book", "at", F.coalesce(F.concat(F.lit("# "), "title"), F.when(F.btrim("text").rlike(r"^#\s+\S"), lower).otherwise(F.col("text"))).alias("text"))


def join_paragraphs(text: Column, least: int = 80) -> Column:
    """Text whose paragraphs run on across a page break: one that begins in lower case follows a long one that ends within a sentence. Headings, lists, images and tables never run on.

    A fold over the paragraphs decides where they run on; the text is put together once.
    """
    facts = lambda ps: F.transform(ps, lambda p: F.struct(F.length(p).alias("n"), p.rlike(r"^\s*[#\-!|]").alias("mark"), p.rlike(rf"[{LETTER}0-9,;–—-]$").alias("open"), p.rlike(rf"^[{LETTER}]").alias("goes_on")))
    start = F.struct(F.array().cast("array<boolean>").alias("joins"), F.lit(0).alias("n"), F.lit(True).alias("mark"), F.lit(False).alias("open"))

    def step(s: Column, p: Column) -> Column:
        on = (s["n"] > least) & ~s["mark"] & s["open"] & p["goes_on"]
        return F.struct(F.concat(s["joins"], F.array(on)).alias("joins"), F.when(on, s["n"] + 1 + p["n"]).otherwise(p["n"]).alias("n"), F.when(on, s["mark"]).otherwise(p["mark"]).alias("mark"), p["open"].alias("open"))

    mark = lambda i, joins: F.when(i == 0, F.lit("")).when(F.get(joins, i), F.lit(" ")).otherwise(F.lit("\n\n"))
    whole = lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(mark(i, x["joins"]), p)), "")
    return let(F.split(text, r"\n\s*\n"), lambda ps: let(F.struct(ps.alias("parts"), F.aggregate(facts(ps), start, step)["joins"].alias("joins")), whole))


def repair_books(pages: DataFrame, chapters: DataFrame | None = None, least_pages: int = 3) -> DataFrame:
    """(book, text) from scanned pages (book, page, text): no running heads or page numbers, chapters as headings, paragraphs joined over page breaks."""
    lines = without_running_heads(page_lines(pages), least_pages).select("book", (F.col("page") * (1 << 20) + F.col("line")).alias("at"), "text")
    if chapters is not None:
        lines = with_chapters(lines, chapters)
    whole = lines.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    tidy = F.concat(strip(F.regexp_replace("text", r"\n{3,}", "\n\n")), F.lit("\n"))
    return whole.select("book", join_paragraphs(tidy).alias("text"))


def contents_as_chapter(text: Column) -> Column:
    """The printed contents as a chapter: its first title line becomes a heading; the title's repetitions up to the next heading go. Null where there is none."""
    before = F.regexp_extract(text, r"(?s)^(.*?)(?:(?<=\n)|(?<![\s\S]))SPIS TREŚCI(?=\n|$)", 1)
    found = text.rlike(r"(?m)^SPIS TREŚCI$")
    rest = F.substring(text, F.length(before) + len("SPIS TREŚCI") + 1, F.length(text))
    region = F.regexp_extract(rest, r"(?s)^(.*?)(?=\n## |$(?!\n))", 1)
    after = F.substring(rest, F.length(region) + 1, F.length(rest))
    kept = F.array_join(F.filter(F.split(region, "\n"), lambda x: ~F.btrim(x).rlike("(?iU)^spis treści$")), "\n")
    return F.when(found, F.concat(before, F.lit("## Spis treści"), F.regexp_replace(kept, r"\n{3,}", "\n\n"), after))


def entry_keys(title: Column) -> Column:
    """What a heading may be for an entry: as printed, and without its number; each also without a final dot."""
    squeeze = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    plain = squeeze(F.regexp_replace(F.btrim(title), r"^\d+\.\s+", ""))
    return F.array_distinct(F.flatten(F.array(*[F.array(c, F.when(c.rlike(r"(^|[^.])\.$"), F.regexp_replace(c, r"\.$", "")).otherwise(c)) for c in (squeeze(title), plain)])))


def link_contents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the dotted lines of their printed contents as links to their headings, in order.

    Entries whose title stands as a line of its own after the contents make that line a heading. Headings get anchors; the k-th entry of a title is
    linked to the k-th heading of that title, by the first form of the title that still has one. Other entries lose their dots and
    page numbers. Lines are rows that meet by document, title and turn; keys must be unique.
    """
    rows = docs.select(F.col(key).alias("k"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    entry = F.regexp_extract("line", r"^(\S.*?)\s+(?:\.\s?){4,}\d{1,4}[ \t]*$", 1)
    rows = rows.withColumns({"entry": F.when(entry != "", F.btrim(entry)), "heading": F.btrim(F.regexp_replace(F.regexp_extract("line", r"^#{2,3} (.+)$", 1), r"\s+", " "))})
    known = rows.where("heading <> ''").select("k", F.col("heading").alias("title")).distinct()
    borders = rows.groupBy("k").agg(F.min(F.when(F.col("line").rlike(rf"(?iU)^\s*{CONTENTS}\s*$"), F.col("at"))).alias("begin"), F.max("at").alias("most"))
    ends = rows.join(borders, "k").where((F.col("at") > F.col("begin")) & F.col("line").startswith("## ")).groupBy("k").agg(F.min("at").alias("end"))
    entries = rows.where("entry IS NOT NULL").select("k", "at", "entry", F.posexplode(entry_keys(F.col("entry"))).alias("form", "title"))
    lost = entries.join(known, ["k", "title"], "left_semi").select("k", "at").distinct()
    missing = entries.join(lost, ["k", "at"], "left_anti").groupBy("k", "at").agg(F.max_by("title", "form").alias("line")).select("k", "line").distinct().withColumn("recovered", F.lit(True))
    limits = borders.join(ends, "k", "left").select("k", F.when(F.col("begin").isNotNull(), F.coalesce("end", F.col("most") + 1)).otherwise(-1).alias("end"))
    marked = rows.join(limits, "k").withColumn("own", F.btrim("line")).join(missing.withColumnRenamed("line", "own"), ["k", "own"], "left")
    marked = marked.withColumn("new", F.col("recovered").isNotNull() & (F.col("at") >= F.col("end")) & F.col("entry").isNull())
    marked = marked.withColumn("title", F.when(F.col("new"), F.col("own")).otherwise(F.col("heading")))
    by_place = Window.partitionBy("k").orderBy("at")
    # the very first line of a text gets no anchor, as nothing may come before a chapter that opens it
    headings = marked.where((F.col("title") != "") & (F.col("at") > 0)).select("k", "at", "title", F.row_number().over(by_place).alias("anchor")).withColumn("turn", F.row_number().over(Window.partitionBy("k", "title").orderBy("at")))
    turns = entries.join(headings.groupBy("k", "title").agg(F.max("turn").alias("there")), ["k", "title"]).groupBy("k", "at").agg(F.min(F.struct("form", "title", "there")).alias("f")).select("k", "at", "f.title")
    turns = turns.withColumn("turn", F.row_number().over(Window.partitionBy("k", "title").orderBy("at")))
    linked = turns.join(headings.select("k", "title", "turn", "anchor"), ["k", "title", "turn"]).select("k", "at", F.col("anchor").alias("to"))
    full = marked.join(linked, ["k", "at"], "left").join(headings.select("k", "at", "anchor"), ["k", "at"], "left")
    head = F.concat(F.when(F.col("anchor").isNotNull(), F.concat(F.lit("[#toc-"), "anchor", F.lit("]\n\n"))).otherwise(F.lit("")), F.when(F.col("new"), F.concat(F.lit("### "), "own", F.lit("\n"))).otherwise(F.col("line")))
    item = F.concat(F.lit("\n"), F.when(F.col("to").isNotNull(), F.concat(F.lit("["), "entry", F.lit("](anchor:toc-"), "to", F.lit(")"))).otherwise(F.col("entry")), F.lit("\n"))
    said = full.select("k", "at", F.when(F.col("entry").isNotNull(), item).when(F.col("title") != "", head).otherwise(F.col("line")).alias("line"))
    whole = said.groupBy("k").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n").alias("linked"))
    return docs.join(whole, docs[key] == whole["k"], "left").drop("k").withColumn(text, F.col("linked")).drop("linked")


#: Where a footnote's number is glued to the word before it: up to three digits between a letter and no letter or digit.
GLUED = r"(?U)(?<=[\p{L}_])(?=\d{1,3}(?![\p{L}\p{N}_]))"


def without_markers(c: Column, n: Column) -> Column:
    """(text, stripped): a chapter without the numbers 1 to n of its footnotes, glued to words, and how many were found.

    Numbers are taken in order only: the next after the one before that is the number expected, whole. SHA256 or x86 stay, as
    they aren't expected where they stand. Null text gives null.
    """
    pieces = F.transform(F.split(c, GLUED), lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.regexp_extract(p, r"^\d{1,3}", 0)).alias("digits")))
    start = F.struct(F.lit(0).alias("found"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hit = F.coalesce(x["digits"].try_cast("int") == s["found"] + 1, F.lit(False)) & (s["found"] < n)
        kept = F.when(hit, F.substr(x["p"], F.length(x["digits"]) + 1)).otherwise(x["p"])
        return F.struct((s["found"] + hit.cast("int")).alias("found"), F.array_append(s["out"], kept).alias("out"))

    return let(F.aggregate(pieces, start, step), lambda s: F.struct(F.array_join(s["out"], "").alias("text"), s["found"].alias("stripped")))


def strip_footnote_markers(books: DataFrame, notes: DataFrame) -> DataFrame:
    """books (book, text) as (book, text, report) without the glued numbers of the footnotes in notes (book, position, n).

    position is a chapter's number from 1, n how many footnotes it has. A chapter in which not all n are found stays as it is.
    The report has (position, expected, stripped, ok) of each chapter of notes that the book has, in order. Books without notes
    stay, with an empty report. Texts are joined with a map a book once, and are not taken apart over rows.
    """
    wanted = notes.where("n > 0").groupBy("book", "position").agg(F.max("n").alias("n")).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.col("position").cast("int"), F.col("n").cast("int")))).alias("wanted"))

    def cut(found: Column) -> Column:
        skipped = F.length(F.rtrim("text", F.lit(SPACE_CHARS))) - F.aggregate(found, F.lit(0), lambda a, x: a + x["length"])
        start = F.struct(skipped.alias("at"), F.array().cast("array<struct<position:int,text:string>>").alias("parts"))
        add = lambda s, x: F.struct((s["at"] + x["length"]).alias("at"), F.array_append(s["parts"], F.struct(x["position"].cast("int").alias("position"), F.substr("text", s["at"] + 1, x["length"]).alias("text"))).alias("parts"))
        # what stands before and after the chapters is white space, and stays
        return let(F.aggregate(found, start, add), lambda s: F.struct(F.substr("text", F.lit(1), skipped).alias("head"), s["parts"].alias("parts"), F.substr("text", s["at"] + 1).alias("tail")))

    def cleaned(x: Column) -> Column:
        n = F.col("wanted")[x["position"]]
        return F.when(n.isNull(), F.struct(x["text"].alias("text"), F.lit(None).cast("struct<position:int,expected:int,stripped:int,ok:boolean>").alias("told"))).otherwise(
            let(without_markers(x["text"], n), lambda w: F.struct(F.when(w["stripped"] == n, w["text"]).otherwise(x["text"]).alias("text"), F.struct(x["position"].alias("position"), n.alias("expected"), w["stripped"].alias("stripped"), (w["stripped"] == n).alias("ok")).alias("told")))
        )

    rows = books.select("book", "text").join(wanted, "book", "left").withColumn("cut", let(chapters(F.col("text")), cut)).withColumn("new", F.transform("cut.parts", cleaned))
    text = F.concat(F.col("cut.head"), F.array_join(F.transform("new", lambda x: x["text"]), ""), F.col("cut.tail"))
    told = F.filter(F.transform("new", lambda x: x["told"]), lambda r: r.isNotNull())
    return rows.select("book", F.when(F.size("new") > 0, text).otherwise(F.col("text")).alias("text"), F.coalesce(told, F.array().cast("array<struct<position:int,expected:int,stripped:int,ok:boolean>>")).alias("report"))


def chapter_sources(c: Column, base: str, intro: str, unnumbered: tuple[str, ...]) -> Column:
    """(position, title, url) of the chapters that have a page of their own: base/r0/ for the one titled intro, base/r1/ and on for all others in order, but for those of unnumbered titles."""

    def of(found: Column) -> Column:
        own = F.filter(F.transform(found, lambda x: F.when(~x["title"].isin(intro, *unnumbered), x["position"])), lambda p: p.isNotNull())
        number = lambda x, ps: F.when(x["title"] == intro, 0).otherwise(F.nullif(F.array_position(ps, x["position"]), F.lit(0)))
        rows = lambda ps: F.transform(found, lambda x: F.struct(x["position"].alias("position"), x["title"].alias("title"), F.concat(F.lit(f"{base}/r"), number(x, ps), F.lit("/")).alias("url")))
        return F.filter(let(own, rows), lambda r: r["url"].isNotNull())

    return let(chapters(c), of)
