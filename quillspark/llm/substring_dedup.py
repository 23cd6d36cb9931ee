"""Exact deduplication of repeated word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .fm_index import ShardIndex
from .word_hashes import Block, hash_words, joined_words, run_hashes, text_blocks


def least_places(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` grams, the place of its least, the leftmost of equals."""
    at, have = np.arange(len(grams)), 1
    while have < span:
        shift = min(have, span - have)
        a, b = at[: len(at) - shift], at[shift:]
        at = np.where(grams[b] < grams[a], b, a)
        have += shift
    return at


def segments_of(b: Block, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, body, more) of the segments of a block of texts: neighbouring windows whose least gram is the same one.

    key is the gram's hash: equal windows have equal keys, wherever they stand. body and more are the XXH128 of the segment's
    words, joined by spaces.
    """
    n = len(b.first) - window + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h, bounds = hash_words(b.data, b.first, b.last), b.bounds
    grams = run_hashes(h, np.arange(len(h) - gram + 1), gram)
    at = least_places(grams, window - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:n] == text[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    breaks = np.append(np.flatnonzero(new | ~inside), n)
    counts = breaks[np.searchsorted(breaks, starts, "right")] - starts
    data, first, last = joined_words(b)
    digests = b"".join([xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(first[starts].tolist(), last[starts + counts - 2 + window].tolist(), strict=True)])
    body = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return text[starts], starts - bounds[text[starts]], counts, grams[at[starts]].view(np.int64), body[:, 0].copy(), body[:, 1].copy()


def split(text) -> list[bytes]:
    return text.as_py().encode().split() if text.is_valid else []


#: A place in a text is one long, in the order of words: the first word above 10 bits of the number of windows.
COUNT_BITS = 10


def place(start: Column, windows: Column) -> Column:
    return F.shiftleft(start.cast("long"), COUNT_BITS) + windows


def start_of(at: Column) -> Column:
    return F.shiftright(at, COUNT_BITS).cast("int")


def windows_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")


def segment_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, version, at, key, body, more) of every segment of the texts in docs (id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                text, start, count, key, body, more = segments_of(block, window, gram)
                row = pa.array(text + block.at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key), pa.array(body), pa.array(more)], names=["id", "version", "start", "windows", "key", "body", "more"])

    rows = docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, version long, start int, windows int, key long, body long, more long")
    return rows.select("id", "version", place(F.col("start"), F.col("windows")).alias("at"), "key", "body", "more")


def hot_windows(docs: DataFrame, keys: list[int], window: int, gram: int) -> DataFrame:
    """(id, version, start, key, body) of the windows of the segments in docs (id, version, text) that have one of the keys; key and body are here the XXH128 of the window's words."""
    wanted = np.array(sorted(keys), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                text, start, count, key, _, _ = segments_of(block, window, gram)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hot = wanted[at] == key
                if not hot.any():
                    continue
                text, start, count = text[hot], start[hot], count[hot]
                of = np.repeat(np.arange(len(count)), count)
                text, start = text[of], start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                data, first, last = joined_words(block)
                begin = block.bounds[text] + start
                digests = b"".join([xxhash.xxh128_digest(data[x:y]) for x, y in zip(first[begin].tolist(), last[begin + window - 1].tolist(), strict=True)])
                body = np.frombuffer(digests, np.int64).reshape(-1, 2)
                row = pa.array(text + block.at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), pa.array(body[:, 0].copy()), pa.array(body[:, 1].copy())], names=["id", "version", "start", "key", "body"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, version long, start int, key long, body long")


def shard_texts(wanted: DataFrame, window: int) -> DataFrame:
    """Cuts the wanted segments (ranges: key, start, windows) out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, (text, ranges) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                words = split(text)
                for r in ranges:
                    s, n = r["start"], r["windows"]
                    out.append((k, s, n, r["key"], b" ".join(words[s : s + n - 1 + window]).decode()))
            if out:
                row, start, windows, key, piece = zip(*out, strict=True)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(key, pa.int64()), pa.array(piece, pa.string())], names=["id", "version", "start", "windows", "key", "piece"])

    kind = dict(wanted.dtypes)["id"]
    return wanted.select("id", "version", "text", "ranges").mapInArrow(run, f"id {kind}, version long, start int, windows int, key long, piece string")


def search_shards(pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(id, version, start, windows): windows of the pieces that also start earlier, by an FM-index per shard.

    pieces are dealt by key and sorted; a shard is some whole keys of about shard_words words. Its segments are indexed in order of
    (id, version, start), so the least place in the text is the earliest occurrence.
    """

    def search(shard: pa.Table) -> pa.Table:
        order = pc.sort_indices(shard, [("id", "ascending"), ("version", "ascending"), ("start", "ascending")], null_placement="at_start")
        shard = shard.take(order).combine_chunks()
        id_ = shard.column("id").combine_chunks()
        version, start, counts = (shard.column(c).to_numpy() for c in ("version", "start", "windows"))
        # repeated rows of a document cut the same segment more than once
        same = pc.fill_null(pc.equal(id_[1:], id_[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(id_[1:]).to_numpy(zero_copy_only=False) & pc.is_null(id_[:-1]).to_numpy(zero_copy_only=False))
        fresh = np.ones(len(version), bool)
        fresh[1:] = ~(same & (version[1:] == version[:-1]) & (start[1:] == start[:-1]))
        keep = np.flatnonzero(fresh)
        # words are numbered by their bytes, so equal numbers are equal words
        pieces = pc.split_pattern(shard.column("piece").combine_chunks().take(pa.array(keep)).cast(pa.large_string()), " ")
        numbers = pieces.flatten().dictionary_encode().indices.to_numpy()
        index = ShardIndex(numbers, pc.list_value_length(pieces).to_numpy(), next(q for q in (4, 3, 2, 1) if window % q == 0))
        counts = counts[keep]
        of = np.repeat(np.arange(len(keep)), counts)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = index.starts[of] + offset
        late = np.flatnonzero(index.repeats(places, window) < places)
        new = np.ones(len(late), bool)
        new[1:] = (np.diff(late) != 1) | (np.diff(of[late]) != 0)
        begin = late[new]
        size = np.diff(np.append(np.flatnonzero(new), len(late)))
        row = keep[of[begin]]
        return pa.table({"id": id_.take(pa.array(row)), "version": pa.array(version[row], pa.int64()), "start": pa.array(start[row] + offset[begin], pa.int32()), "windows": pa.array(size, pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys, weight = batch.column(5).to_numpy(), batch.column(3).to_numpy() + window
            turns = np.flatnonzero(np.concatenate(([not held or held[-1].column(5)[-1].as_py() != keys[0]], keys[1:] != keys[:-1])))
            at, total = 0, np.concatenate(([0], np.cumsum(weight)))
            for turn in turns:  # a shard ends only where a key does
                if size + total[turn] - total[at] >= shard_words:
                    held.append(batch.slice(at, turn - at))
                    yield from search(pa.Table.from_batches(held)).to_batches()
                    held, size, at = [], 0, turn
            held.append(batch.slice(at))
            size += total[-1] - total[at]
        if held:
            yield from search(pa.Table.from_batches(held)).to_batches()

    kind = dict(pieces.dtypes)["id"]
    dealt = pieces.select("id", "version", "start", "windows", "piece", "key").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"id {kind}, version long, start int, windows int")


def remove_ranges(joined: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept_text) from (id, text, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            ranges = batch.column(2)
            flat, ends = ranges.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
            starts, stops = flat.field("start").to_numpy(), flat.field("start").to_numpy() + flat.field("windows").to_numpy() - 1 + window
            a = 0
            for text, b in zip(batch.column(1), ends.tolist(), strict=True):
                left = words = split(text)
                if a < b:
                    edges = np.bincount(starts[a:b], minlength=len(words) + 1) - np.bincount(stops[a:b], minlength=len(words) + 1)
                    left = list(compress(words, (np.cumsum(edges) == 0).tolist()))
                    a = b
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return joined.select("id", "text", "ranges").mapInArrow(run, f"id {dict(joined.dtypes)['id']}, n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 5, shard_words: int = 400_000, hot_contents: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word under a window of `window` words that also starts earlier (smaller id, or earlier in the text).

    Texts are cut into segments, neighbouring windows that share their least gram; equal windows get equal keys.
    Keys that occur once are done. Of the others, equal segments (by the XXH128 of their words) collapse to their first instance; later instances go
    whole. Keys with several contents are dealt to shards, where an FM-index over words as they are finds the windows of one segment
    in another. Keys of over hot_contents contents are too large for a shard: their windows are hashed one by one and grouped
    instead, which is exact too. These keys, at most one in hot_contents of all segments, are told to the tasks that hash, so that texts
    are shuffled by document once (one exchange serves both joins), with hot keys or without. Counts and firsts are taken in two steps (partial, then final), so common passages
    and copies are spread over all tasks, and a shard stays bounded.

    Returns a row per input row: id_col, n_words, n_removed, kept_text (kept words joined by a space). Null text has no words.
    Null ids come before all others. Rows that repeat an id and text are one document and are treated alike; other texts
    of an id are told apart, and ordered, by a hash of the text of 64 bits. Other columns are ignored. An empty table gives an empty table.
    """
    if not 1 <= gram <= window < 1 << COUNT_BITS:
        raise ValueError(f"1 <= gram <= window < {1 << COUNT_BITS} must hold")
    version = F.xxhash64(text_col)
    texts = docs.select(F.col(id_col).alias("id"), version.alias("version"), F.col(text_col).alias("text"))
    found = segment_rows(texts, window, gram)
    # stored, so that the join's both sides are plain shuffles and a hot key's rows are split over tasks
    often = stored(found.groupBy("key").count().where(F.col("count") > 1).select("key"))
    again = stored(found.join(often, "key"))
    first = F.struct("id", "version", "at")
    spread = lambda rows: rows.select("id", "version", start_of(F.col("at")).alias("start"), windows_of(F.col("at")).alias("windows"))
    firsts = stored(again.groupBy("key", "body", "more").agg(F.count("*").alias("times"), F.min(first).alias("first")))
    copies = spread(again.join(firsts.where("times > 1").select("key", "body", "more", "first"), ["key", "body", "more"]).where(~first.eqNullSafe(F.col("first"))))
    contents = firsts.groupBy("key").count().where(F.col("count") > 1).select("key", (F.col("count") > hot_contents).alias("hot"))
    hot = [r["key"] for r in contents.where("hot").select("key").toLocalIterator()]
    unsure = firsts.join(contents.where("NOT hot"), "key").select("first.id", "first.version", "first.at", "key")
    range_of = F.struct("key", start_of(F.col("at")).alias("start"), windows_of(F.col("at")).alias("windows"))
    wanted = unsure.groupBy("id", "version").agg(F.collect_list(range_of).alias("ranges"))
    rename = lambda df: df.withColumnsRenamed({"id": "i", "version": "v"})
    same = texts["id"].eqNullSafe(F.col("i")) & (texts["version"] == F.col("v"))
    pieces = shard_texts(texts.join(rename(wanted), same).select("id", "version", "text", "ranges"), window)
    late = copies
    if hot:
        single = stored(hot_windows(texts, hot, window, gram))
        where = F.struct("id", "version", "start")
        earliest = single.groupBy("key", "body").agg(F.min(where).alias("first"), F.count("*").alias("times")).where("times > 1").select("key", "body", "first")
        late = late.unionByName(single.join(earliest, ["key", "body"]).where(~where.eqNullSafe(F.col("first"))).select("id", "version", "start", F.lit(1).alias("windows")))
    searched = search_shards(pieces, window, shard_words)
    ranges = late.unionByName(searched).groupBy("id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
    joined = texts.join(rename(ranges), same, "left").select("id", "text", "ranges")
    return remove_ranges(joined, window).withColumnRenamed("id", id_col)
