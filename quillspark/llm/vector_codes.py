"""Vector codes: one codebook for each part of a vector, fitted and searched in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored

#: Components up to 2^27 in whole numbers: squared distances and their sums over parts then fit into 64 bits.
MOST = 1 << 27


class Codes(NamedTuple):
    """coded: the input's kept rows with code and error; codebooks: parts x entries x components."""

    coded: DataFrame
    codebooks: np.ndarray


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of a codebook for each row, ties to the lower index, by partial distances.

    Components are gone through in descending variance over the codebook. A row leaves an entry's comparison once its
    accumulated distance strictly exceeds the row's best complete distance.
    """
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    rows, entries = np.ascontiguousarray(parts[:, order].T), book[:, order]
    best = ((rows - entries[0][:, None]) ** 2).sum(axis=0)
    index = np.zeros(len(parts), np.int64)
    for e in range(1, len(entries)):
        live, sums = np.arange(len(parts)), np.zeros(len(parts), np.int64)
        for values, x in zip(rows, entries[e], strict=True):
            sums = sums + (values[live] - x) ** 2
            keep = sums <= best[live]
            live, sums = live[keep], sums[keep]
            if not len(live):
                break
        better = sums < best[live]  # an equal distance stays with the lower index
        best[live[better]], index[live[better]] = sums[better], e
    return index, best


def matrix(vectors: pa.Array, parts: int, dims: int, scale: int) -> np.ndarray:
    """Rows of whole numbers, cut into parts; missing components of the last part are zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale).astype(np.int64).reshape(len(vectors), dims)
    own = -(-dims // parts)
    out = np.zeros((len(vectors), parts * own), np.int64)
    out[:, :dims] = whole
    return out.reshape(len(vectors), parts, own)


def book_sums(vectors: DataFrame, books: np.ndarray, parts: int, dims: int, scale: int) -> DataFrame:
    """(part, entry, n, sums) of the rows nearest to each entry, a row for each entry and Arrow batch, then summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.shape[2]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            rows = matrix(batch.column(0), parts, dims, scale)
            for p in range(parts):
                index, _ = nearest(rows[:, p], books[p])
                n[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(sums[p], index, rows[:, p])
        part, entry = np.nonzero(n)
        flat = pa.array(sums[part, entry].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * own), flat)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), lists], names=["part", "entry", "n", "sums"])

    each = vectors.mapInArrow(run, "part long, entry long, n long, sums array<long>")
    width = range(books.shape[2])
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in width]).alias("sums"))


def is_kept(vector: Column) -> Column:
    """Vectors that aren't null and hold finite numbers only."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def code_vectors(
    rows: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Codes:
    """Codes of all vectors: for each of `parts` equal consecutive parts the index of its codebook's nearest entry.

    Components become floor(scale * x). A part's codebook starts as that part of the `entries` vectors of the smallest ids (nulls
    last, ties in order of the vectors); each of `rounds` rounds assigns all parts and replaces an entry by the
    rounded down mean of its parts; unused entries stay. Every round passes over all rows; a row for each entry comes to the driver.

    coded has the kept rows with all their columns (those named code or error are replaced), code (array of indexes, part by part) and error
    (squared distances, summed). Vectors that are null or hold null or non-finite components are dropped. Those whose length differs from the first
    one's, and those with components beyond 2^27 / scale, whose distances need not fit into 64 bits, stay with a null code and
    error and take no part in the fit. With fewer rows than entries there are fewer entries; an empty table gives an
    empty one and no codebooks.
    """
    kept = rows.where(is_kept(column(rows, vector_col)))
    first = [r[0] for r in kept.select(column(kept, vector_col).alias("v"), column(kept, id_col).alias("i")).orderBy(F.col("i").asc_nulls_last(), "v").limit(1).collect()]
    dims = len(first[0]) if first else 0
    able = (F.size(column(kept, vector_col)) == dims) & F.forall(column(kept, vector_col), lambda x: F.abs(x.cast("double")) <= float(MOST // scale))
    numbers = kept.where(able).select(column(kept, vector_col).alias("v"), column(kept, id_col).alias("i"))
    smallest = [r.v for r in numbers.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()] if dims else []
    own = -(-dims // parts)
    books = np.zeros((parts, len(smallest), own), np.int64)
    if smallest:
        books = matrix(pa.array(smallest, pa.list_(pa.float64())), parts, dims, scale).transpose(1, 0, 2).copy()
        for _ in range(rounds):
            for r in book_sums(numbers.select("v"), books, parts, dims, scale).collect():
                books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ok = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            n = int(ok.sum())
            codes, errors = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
            if n:
                numbers = matrix(vectors.filter(batch.column(1)), parts, dims, scale)
                for p in range(parts):
                    codes[:, p], error = nearest(numbers[:, p], books[p])
                    errors += error
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(ok, parts, 0)))).astype(np.int32)), pa.array(codes.ravel()), mask=pa.array(~ok))
            spread = np.zeros(len(ok), np.int64)
            spread[ok] = errors
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists, pa.array(spread, mask=~ok)], names=[*batch.schema.names[2:], "code", "error"])

    others = [c for c in kept.columns if c.lower() not in ("code", "error")]
    inside = kept.select(column(kept, vector_col).alias("vector"), (able & F.lit(bool(smallest))).alias("able"), *[column(kept, c).alias(f"c{k}") for k, c in enumerate(others)])
    kinds = [f.dataType.simpleString() for f in inside.schema.fields[2:]]
    coded = inside.mapInArrow(run, ", ".join([*(f"c{k} {kind}" for k, kind in enumerate(kinds)), "code array<int>", "error long"]))
    return Codes(coded.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], "code", "error"), books)


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds label_error: the error summed over the rows of the same label, nulls together. Summed before the join, so a hot label isn't gathered."""
    rows = stored(coded)
    sums = rows.groupBy(column(rows, label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, column(rows, label_col).eqNullSafe(F.col("__label")), "left").drop("__label")


def told_code(code: Column) -> Column:
    """Indexes as two lower-case hex digits each."""
    return F.array_join(F.transform(code, lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
