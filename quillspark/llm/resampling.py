"""Target-distribution importance resampling over hashed word n-grams, whose CRCs are composed from the words' CRCs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .word_hashes import text_blocks

#: The reflected polynomial of CRC-32; words of a-z, 0-9 and all beyond ASCII.
POLYNOMIAL = 0xEDB88320
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Shifts by fewer bytes have tables of their own; longer ones are put together from these and from powers of two.
NEAR_BITS = 8
#: Words of more bytes are summed up one by one.
LONG_WORD = 256


def byte_table() -> np.ndarray:
    """CRC of each byte, without the inversions."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), crc >> np.uint32(1))
    return crc


BYTE = byte_table()


def shift_tables(columns: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given by what it makes of each of 32 bits, as four tables of 256: one for each byte of the operand."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[8 * byte + bit], np.uint32(0))
    return out


def apply_tables(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return tables[0][crc & low] ^ tables[1][crc >> np.uint32(8) & low] ^ tables[2][crc >> np.uint32(16) & low] ^ tables[3][crc >> np.uint32(24)]


class Shifts:
    """crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where a shift by n bytes is a matrix over GF(2)."""

    def __init__(self) -> None:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = shift_tables(BYTE[bits & np.uint32(255)] ^ (bits >> np.uint32(8)))
        # columns of shifts by 0, 1, 2, ... bytes
        columns = [bits]
        for _ in range((1 << NEAR_BITS) - 1):
            columns.append(apply_tables(one, columns[-1]))
        self.near = np.stack([shift_tables(c) for c in columns])
        doubled = apply_tables(one, columns[-1])
        self.far = []
        for _ in range(NEAR_BITS, 40):  # by 2^8, 2^9, ... bytes: a shift after itself is a shift by twice as many
            self.far.append(shift_tables(doubled))
            doubled = apply_tables(self.far[-1], doubled)

    def __call__(self, crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        low, n = np.uint32(255), sizes & ((1 << NEAR_BITS) - 1)
        out = self.near[n, 0, crc & low] ^ self.near[n, 1, crc >> np.uint32(8) & low] ^ self.near[n, 2, crc >> np.uint32(16) & low] ^ self.near[n, 3, crc >> np.uint32(24)]
        high = sizes >> NEAR_BITS
        for k in range(int(high.max(initial=0)).bit_length()):
            some = np.flatnonzero(high >> k & 1)
            out[some] = apply_tables(self.far[k], out[some])
        return out


SHIFT = Shifts()
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The CRC of data[first:last] for each pair, a byte of all words at a time."""
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    who = np.flatnonzero(last - first <= LONG_WORD)
    at, end = first[who], last[who]
    while len(who):
        crc[who] = BYTE[(crc[who] ^ data[at]) & np.uint32(255)] ^ (crc[who] >> np.uint32(8))
        more = end - at > 1
        who, at, end = who[more], at[more] + 1, end[more]
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(last - first > LONG_WORD).tolist():
        crc[k] = zlib.crc32(data[first[k] : last[k]].tobytes())
    return crc


def gram_crcs(crc: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """CRCs of the runs of 1 to `most` words, joined by a space, that begin at each word: as many as fit. Texts' borders are ignored."""
    # of each word with a space before it
    spaced = SHIFT(np.full(len(crc), SPACE_CRC, np.uint32), sizes) ^ crc
    grams = crc
    yield grams
    for n in range(2, most + 1):
        if n > len(crc):
            return
        grams = SHIFT(grams[:-1], sizes[n - 1 :] + 1) ^ spaced[n - 1 :]
        yield grams


def text_features(column: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(number of the first text, words of each text, [(text, bucket) of runs of 1, 2, ... words]) of blocks of texts."""
    for b in text_blocks(column, WORD_BYTES, lower=True):
        text = np.repeat(np.arange(len(b.bounds) - 1), np.diff(b.bounds))
        crcs = gram_crcs(word_crcs(b.data, b.first, b.last), b.last - b.first, most)
        found = []
        for n, grams in enumerate(crcs, 1):
            inside = text[: len(grams)] == text[n - 1 :]
            found.append((text[: len(grams)][inside], (grams[inside] % np.uint32(buckets)).astype(np.int64)))
        yield b.at, np.diff(b.bounds), found


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all features of texts (text), counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in text_features(batch.column(0), most, buckets):
                for _, bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, most: int, buckets: int) -> np.ndarray:
    """1000 times the log ratio of smoothed target and corpus shares of each bucket, rounded down. One number a bucket comes to the driver."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s, t = (bucket_counts(x, most, buckets).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    rows = np.array(both.select("bucket", "s", "t").collect(), np.int64).reshape(-1, 3)
    sums = rows[:, 1:].sum(axis=0)
    counted = docs.sparkSession.createDataFrame(rows.tolist(), "bucket long, s long, t long")
    share = (F.col("t") + 1.0) * float(sums[0] + buckets) / ((F.col("s") + 1.0) * float(sums[1] + buckets))
    told = counted.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in told:
        gains[bucket] = gain
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """(id, n_words, n_features, weight) of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, found in text_features(batch.column(1), most, len(gains)):
                features, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for text, bucket in found:
                    edges = np.searchsorted(text, np.arange(len(words) + 1))
                    sums = np.concatenate(([0], np.cumsum(gains[bucket])))
                    features += np.diff(edges)
                    weight += np.diff(sums[edges])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: float) -> DataFrame:
    """rows (id, n_words, ..., score, able) with the rank of the best floor(share percent of the able ones) by score, ties to smaller ids (nulls first).

    Able rows are dealt and sorted by ranges; the numbers of rows in the ranges before a range, one row a range, give a row's rank.
    """
    able = rows.where("able")
    drawn = F.floor(F.lit(share) * F.lit(able.count()) / 100)
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), "n_features", "row"]
    dealt = stored(able.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    # ranges beyond the drawn ones keep no order
    placed = dealt.join(offsets, "range")
    first = placed.where(F.col("before") < drawn)
    at = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    numbered = first.withColumn("rank", F.when(at <= drawn, at)).drop("range", "before")
    rest = placed.where(F.col("before") >= drawn).drop("range", "before").unionByName(rows.where("NOT able"))
    return numbered.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    share: float = 5,
    least_words: int = 20,
    most: int = 3,
    buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Draws documents that resemble a target: Gumbel top-k over the log ratio of target and corpus shares of their hashed n-grams.

    Features are runs of 1 to `most` words (A-Z lower-cased; letters, digits and all beyond ASCII), with repeats; a feature's bucket is
    the CRC-32 of the run joined by spaces, modulo `buckets`. A word's CRC is computed once; those of longer runs are composed
    from it by GF(2) shifts, so no run is ever built. Counts, gains and ranks cover all rows; what the driver holds is a number a bucket.
    Of the rows with at least least_words words, floor(share percent) are drawn.

    Returns a row per input row: id_col, n_words, n_features, weight, score, rank (null: not drawn). Null text has no words. A null id is
    hashed as `null` and comes before all others in ties; repeated rows are rows of their own. Other columns are
    ignored. An empty table gives an empty table, an empty target flat gains of the corpus.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gains = bucket_gains(texts.select("text"), target.select(F.col(target_col).alias("text")), most, buckets)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = weigh(texts, gains, most).select("*", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("row"))
    out = ranked(stored(weighed), share)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that importance_ranks draws, with all their columns; ids must be unique."""
    drawn = importance_ranks(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("__drawn"))
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("__drawn")), "left_semi")
