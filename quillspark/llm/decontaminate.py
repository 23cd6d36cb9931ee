"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keeps_names, let, lower_az, steps, with_columns

#: Everything in ASCII that is no digit, A-Z or a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows and bytes of benchmark fingerprints, windows or suspects that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 1 << 26


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BREAKS), "")


def fingerprints(words: Column, window: int, gram: int) -> Column:
    """For each window of words the least hash among its grams: windows that are equal have equal fingerprints."""
    span = window - gram + 1
    hashes = F.transform(steps(F.size(words) - (gram - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))
    return let(hashes, lambda h: F.transform(steps(F.size(h) - (span - 1)), lambda i: F.least(*[F.get(h, i + j) for j in range(span)])))


def runs(prints: Column, window: int) -> Column:
    """Neighbouring windows of one fingerprint, as (print, size, first, last)."""
    begins = F.filter(steps(F.size(prints)), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))

    def closed(at: Column) -> Column:
        return F.transform(
            at,
            lambda first, k: F.struct(
                F.get(prints, first).alias("print"),
                F.lit(window).alias("size"),
                first.alias("first"),
                (F.coalesce(F.get(at, k + 1), F.size(prints)) - 1).alias("last"),
            ),
        )

    return let(begins, closed)


def whole(words: Column, size: int) -> Column:
    """Every window of a given size, hashed: for items of fewer words than a window."""
    return F.transform(
        steps(F.size(words) - (size - 1)),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(size)]).alias("print"), F.lit(size).alias("size"), i.alias("first"), i.alias("last")),
    )


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of their strings are counted to be within BROADCAST_ROWS and BROADCAST_BYTES."""
    size = sum((F.octet_length(c) for c, kind in df.dtypes if kind == "string"), F.lit(16))
    rows, most = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and most <= BROADCAST_BYTES else df


@keeps_names
def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks the document words that stand in any benchmark window of `window` words.

    Winnowing: a window's fingerprint is the least hash of its grams of `gram` words, so each shared window shares a
    fingerprint. Documents give one row per run of windows with one fingerprint; these join the fingerprints of the
    benchmark; each hit extends to the windows of its run, which are compared word for word. Items of fewer words than
    a window are one window each and found by the hash of the whole; null or wordless items have none.

    Adds n_words, n_hit, n_items, item_ids (sorted strings), contaminated (replacing input columns of these names). All
    rows stay. Null text has no words. Repeated rows, equal texts of one id and null ids are each judged by their text.
    A null item_id is reported as the string "null". The tables may be empty. A side is broadcast only after its rows and bytes are
    counted. Windows carry two hashes as their id; which items hold a window is joined at the end, on ids alone, so nothing
    depends on how many items hold one. Only texts with hits are read again, and only they may be shuffled.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    spans = items.select("item", "words", size.alias("size"), F.explode(steps(F.size("words") - size + 1)).alias("first"))
    spans = spans.select("size", F.array_join(F.slice("words", F.col("first") + 1, F.col("size")), " ").alias("span"), "item").distinct()
    spans = cut(spans.select("size", "span", F.xxhash64("size", "span").alias("w1"), F.xxhash64("span", "size").alias("w2"), "item"))
    windows = cut(spans.select("size", "span", "w1", "w2").distinct())
    short = [r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect()]  # below window: a few at most
    sw = F.split("span", " ")
    key = F.when(F.col("size") == window, F.get(fingerprints(sw, window, gram), F.lit(0)))
    for n in short:
        key = F.when(F.col("size") == n, F.xxhash64(*[F.get(sw, F.lit(j)) for j in range(n)])).otherwise(key)
    wanted = cut(windows.select("size", key.alias("print")).distinct())

    text = F.col(text_col)
    found = let(item_words(text), lambda ws: F.concat(let(fingerprints(ws, window, gram), lambda p: runs(p, window)), *[whole(ws, n) for n in sorted(short)]))
    ids = {"__id": F.col(id_col), "__version": F.xxhash64(text_col)}
    hits = cut(
        docs.select(*[v.alias(k) for k, v in ids.items()], F.explode(found).alias("run"))
        .select("__id", "__version", "run.*")
        .join(small(wanted), ["print", "size"])
        .select("__id", "__version", "size", "first", "last")
        .distinct()
    )
    both = lambda a, b: a["__id"].eqNullSafe(b["__i"]) & (a["__version"] == b["__v"])
    other = lambda df: df.withColumnsRenamed({"__id": "__i", "__version": "__v"})
    # texts of documents with hits only; the windows of their runs are then compared word for word
    suspects = other(cut(hits.select("__id", "__version").distinct()))
    texts = docs.select(*[v.alias(k) for k, v in ids.items()], text.alias("__text"))
    texts = texts.join(small(suspects), both(texts, suspects), "left_semi").dropDuplicates(["__id", "__version"])
    places = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(r["size"].alias("size"), i.alias("first")))))
    held = other(hits.groupBy("__id", "__version").agg(F.collect_list(F.struct("size", "first", "last")).alias("runs")))
    cut_out = let(item_words(F.col("__text")), lambda ws: F.transform(places, lambda s: F.struct(s["size"].alias("size"), s["first"].alias("first"), F.array_join(F.slice(ws, s["first"] + 1, s["size"]), " ").alias("span"))))
    read = texts.join(held, both(texts, held)).select("__id", "__version", F.explode(cut_out).alias("s")).select("__id", "__version", "s.*")
    verified = cut(read.join(small(windows), ["size", "span"]).select("__id", "__version", "size", "first", "w1", "w2"))
    hit = verified.groupBy("__id", "__version").agg(F.collect_set(F.struct("size", "first")).alias("__spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1)))))
    names = verified.select("__id", "__version", "w1", "w2").distinct().join(spans.select("w1", "w2", "item"), ["w1", "w2"]).select("__id", "__version", "item").distinct()
    names = other(names.groupBy("__id", "__version").agg(F.sort_array(F.collect_list("item")).alias("__item_ids")))
    hit = hit.select("__id", "__version", covered.alias("__hit"))
    marked = other(cut(hit.join(names, both(hit, names)).select("__id", "__version", "__hit", "__item_ids")))
    none = F.array().cast("array<string>")
    # figures of the text are taken before the join, so that a query that needs no text shuffles none
    counted = with_columns(docs, [], n_words=F.size(item_words(text)).cast("long"), **ids)
    return with_columns(
        counted.join(marked, both(counted, marked), "left"),
        ["__id", "__version", "__i", "__v", "__hit", "__item_ids"],
        n_hit=F.coalesce("__hit", F.lit(0)).cast("long"),
        n_items=F.size(F.coalesce("__item_ids", none)).cast("long"),
        item_ids=F.coalesce("__item_ids", none),
        contaminated=F.col("__hit").isNotNull(),
    )
