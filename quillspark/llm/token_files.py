"""Token ids in files: a zstandard frame for each document over one trained dictionary, in order of id, with the frames' offsets."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_hashes import LOWER, Block, text_blocks

#: What a worker keeps of words and pieces already encoded, at most.
KEPT_WORDS = 600_000
#: Bytes of texts whose words are looked up at a time.
ENCODED_AT_ONCE = 1 << 23
#: White space other than the line ends that part words here, and the beginning of a control token: such words are encoded whole.
_OTHER_SPACE, _CONTROL = re.compile(r"[^\S\n]"), "<|"
#: Fixed value: a splitter that makes pieces of letters, single digits and runs of other marks. Its pieces of plain ASCII words are found without it.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 1 letters, 2 digits, 3 other visible marks of ASCII; 0 makes a word one that only the tokenizer splits. Letters of two bytes, the first of which is C3, are letters, too.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[39, 124]] = 0
_LATIN = 0xC3
_SECOND = np.zeros(256, np.uint8)
_SECOND[0x80:0xC0] = 1
_SECOND[[0x97, 0xB7]] = 0  # the signs of multiplication and division
_LOWER_SECOND = np.arange(256, dtype=np.uint8)
_LOWER_SECOND[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
_PLAIN = re.compile("[!-&(-{}~À-ÖØ-öø-ÿ]+")
#: Byte-level merges see each byte as a character: those that print as themselves, the others from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each pair, one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Encoder:
    """A tokenizer of the tokenizers library. by_words: words parted by ASCII white space are encoded once each and put together.

    by_words holds for a tokenizer that drops white space before its merges, so no token and no rule of it spans two words. If its
    splitter is LETTER_RUNS over lower-case text, words of plain ASCII and Latin letters fall into its pieces right here, and only pieces are merged.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.merge = self.tokenizer.model.tokenize
        told = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_runs = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": LETTER_RUNS} and not splits[1]["add_prefix_space"]
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, piece: str) -> list[int]:
        return [t.id for t in self.merge(piece)]

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words, by the tokenizer's own normalizer, splitter and merges; each distinct piece is merged once."""
        out: list[list[int]] = []
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            joined = "\n".join(some)
            normal = self.tokenizer.normalizer.normalize_str(joined)
            borders = np.array([i for i, c in enumerate(normal) if c == " "])
            if len(borders) != len(some) - 1 or _CONTROL in joined or _OTHER_SPACE.search(joined):
                out += self._whole(some)
                continue
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            own: list[list[int]] = [[] for _ in some]
            for (piece, _), word in zip(found, np.searchsorted(borders, [at for _, (at, _) in found]).tolist(), strict=True):
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.pieces[piece] = self._merged(piece)
                own[word] += ids
            out += own
        if len(self.pieces) > KEPT_WORDS:
            self.pieces = {}
        return out

    def _rows_of(self, units: list[str]) -> np.ndarray:
        """Where the ids of distinct units (words, or pieces in lower case) are kept."""
        if len(self.rows) > KEPT_WORDS:
            self._forget()
        get = self.rows.get
        found = np.array([get(u, -1) for u in units], np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [units[k] for k in missing.tolist()]
            hard = [k for k, u in enumerate(new) if not (self.by_runs and _PLAIN.fullmatch(u))]
            ids = [[]] * len(new)
            for k, own in zip(hard, self._ids([new[k] for k in hard]), strict=True):
                ids[k] = own
            merge, easy = self.merge, np.ones(len(new), bool)
            easy[hard] = False
            for k in np.flatnonzero(easy).tolist():
                piece = new[k] if new[k].isascii() else new[k].encode().decode("latin-1").translate(_BYTES)
                ids[k] = [t.id for t in merge(piece)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))))
            found[missing] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows.update(zip(new, found[missing].tolist(), strict=True))
        return found

    def _units(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, borders, bounds) of a block's units: bytes[borders[k]:borders[k + 1]] is one, text i has the units bounds[i] to bounds[i + 1]."""
        data, sizes = b.data[b.inside], b.last - b.first
        starts = np.concatenate(([0], np.cumsum(sizes)))
        if not self.by_runs or not len(data):
            return data, starts, b.bounds
        kind, lower = _CLASS[data], LOWER[data]
        second = np.flatnonzero(data[:-1] == _LATIN) + 1
        kind[second], lower[second] = _SECOND[data[second]], _LOWER_SECOND[data[second]]
        kind[second - 1] = kind[second]
        plain = np.repeat(np.minimum.reduceat(kind, starts[:-1]) > 0, sizes)
        new = np.ones(len(data), bool)
        new[1:] = plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        new[starts[:-1]] = True
        borders = np.append(np.flatnonzero(new), len(data))
        return np.where(plain, lower, data), borders, np.searchsorted(borders, starts[b.bounds])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, bounds) of blocks of texts. Null is empty."""
        if not self.by_words:
            found = self._whole([x or "" for x in column.to_pylist()])
            yield 0, np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0, *map(len, found)])
            return
        for b in text_blocks(column, size=ENCODED_AT_ONCE):
            data, borders, bounds = self._units(b)
            units = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            rows = self._rows_of(units.dictionary.to_pylist())[units.indices.to_numpy()] if len(borders) > 1 else np.zeros(0, np.int64)
            counts = self.sizes[rows]
            yield b.at, ragged(self.flat, self.starts[rows], counts), np.concatenate(([0], np.cumsum(counts)))[bounds]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_words: bool) -> Encoder:
    """One for each worker."""
    if (path, by_words) not in _ENCODERS:
        _ENCODERS[path, by_words] = Encoder(path, by_words)
    return _ENCODERS[path, by_words]


def documents_ids(column: pa.Array, path: str, by_words: bool, end_id: int | None, kind: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As the encoder gives them, with end_id after each document, as little-endian numbers of the files."""
    for at, ids, bounds in encoder(path, by_words)(column):
        if end_id is not None:
            ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
        yield at, ids.astype(kind), bounds


def train_dictionary(docs: DataFrame, ids_of, sample_docs: int, sample_bytes: int, size: int) -> bytes:
    """A zstandard dictionary over the serialized ids of about sample_docs rows of docs (id, text), drawn by a hash of both, of which a run of at most sample_bytes is taken at a place drawn alike. Empty where there is too little to train on."""
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    chosen = docs.withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = batch.column(1).to_numpy(), []
            for at, ids, bounds in ids_of(batch.column(0)):
                most = sample_bytes // ids.itemsize
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    a += int(h[at + k] >> 32) % max(1, b - a - most + 1)
                    out.append(ids[a : min(b, a + most)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["sample"])

    # repeated rows are drawn together, so the number of samples is bounded once more
    samples = sorted(bytes(r.sample) for r in chosen.select("text", "h").mapInArrow(run, "sample binary").limit(2 * sample_docs).collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _given(dictionary: bytes) -> dict[str, Any]:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    by_words: bool = False,
    end_id: int | None = None,
    vocabulary: int = 1 << 32,
    pack_bytes: int = 4 << 20,
    sample_docs: int = 1000,
    sample_bytes: int = 1 << 14,
    dictionary_bytes: int = 1 << 16,
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every whole text and writes its ids into a folder, in ascending order of id_col.

    The folder gets three tables. `dictionary` has one row: the trained dictionary and its SHA-256. `packs` has the frames: a
    row holds the frames of some neighbouring documents (about pack_bytes) one after another, their ids, their offsets in
    it, their token counts, the dictionary's hash, its part and how many token ids that part has before it. `parts` has the token
    ids before each part. A document is one frame: its ids as little-endian 16-bit (vocabulary up to 65536) or 32-bit numbers.

    Rows are dealt by ranges of (id, text), so a hot id is split; a task holds a pack and an Arrow batch of texts. The
    dictionary is fitted on about sample_docs rows, at most sample_bytes of each; all else covers all rows. tokenizer_path must be
    readable on every executor. by_words: see Encoder.

    Null ids come before all others, rows of one id in order of their texts' hashes; null text counts as empty; repeated rows are
    documents of their own. Other columns are ignored. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids_of = lambda column: documents_ids(column, tokenizer_path, by_words, end_id, kind)
    dictionary = train_dictionary(texts, ids_of, sample_docs, sample_bytes, dictionary_bytes)
    told, id_type = dictionary_hash(dictionary), dict(texts.dtypes)["id"]
    spark.createDataFrame([(told, dictionary)], "hash string, dictionary binary").write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level, **_given(dictionary))
        before = 0
        names = pa.chunked_array([], pa.null())
        frames: list[bytes] = []
        counts: list[int] = []

        def pack() -> pa.RecordBatch:
            held = names.combine_chunks() if names.num_chunks != 1 else names.chunk(0)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
            row = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), held.slice(0, 1), held.slice(len(held) - 1, 1), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)]
            row += [pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary()), pa.array([told]), pa.array([kind.itemsize], pa.int32())]
            return pa.RecordBatch.from_arrays(row, names=["part", "before", "first_id", "last_id", "ids", "offsets", "counts", "body", "dictionary", "width"])

        part = size = 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            for at, ids, bounds in ids_of(batch.column(2)):
                begin = at
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    frames.append(compressor.compress(ids[a:b].tobytes()))
                    counts.append(b - a)
                    size += len(frames[-1])
                    if size >= pack_bytes:
                        names = _joined(names, batch.column(1).slice(begin, at + k + 1 - begin))
                        yield pack()
                        before, begin, size = before + sum(counts), at + k + 1, 0
                        names, frames, counts = pa.chunked_array([], pa.null()), [], []
                names = _joined(names, batch.column(1).slice(begin, at + len(bounds) - 1 - begin))
        if frames:
            yield pack()

    # the row number tells equal rows apart, so that many of them don't meet in one range
    keyed = texts.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), "h", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")
    schema = f"part int, before long, first_id {id_type}, last_id {id_type}, ids array<{id_type}>, offsets array<long>, counts array<long>, body binary, dictionary string, width int"
    dealt.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{folder}/packs")
    packs = spark.read.schema(schema).parquet(f"{folder}/packs")
    # a row for each task of the write goes through one window; documents and packs don't
    sizes = packs.groupBy("part").agg(F.max(F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")).write.parquet(f"{folder}/parts")


def _joined(names: pa.ChunkedArray, more: pa.Array) -> pa.ChunkedArray:
    return pa.chunked_array([more]) if not len(names) else pa.chunked_array([*names.chunks, more]) if len(more) else names


def read_token_files(spark: SparkSession, folder: str, wanted: Sequence | None = None) -> DataFrame:
    """(id, start, n_tokens, ids) of the documents in a folder that write_token_files wrote: start is the number of token ids before, ids are little-endian unsigned 32-bit numbers.

    wanted: only the documents of these ids. Packs beyond them are skipped by their first and last id, and only their own frames are
    decompressed. A pack that names another dictionary than the folder's is an error.
    """
    found = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, told = bytes(found.dictionary), found.hash
    packs = spark.read.parquet(f"{folder}/packs")
    chosen = None if wanted is None else set(wanted)
    if chosen is not None:
        known = [x for x in chosen if x is not None]
        within = F.lit(False) if not known else (F.col("first_id").isNull() | (F.col("first_id") <= max(known))) & (F.col("last_id") >= min(known))
        packs = packs.where(within | F.col("first_id").isNull() if None in chosen else within)
    id_type = dict(packs.dtypes)["first_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor(**_given(dictionary))
        for batch in batches:
            for k in range(len(batch)):
                at, names, offsets, counts, body, hashed, width = (batch.column(c)[k] for c in range(7))
                if hashed.as_py() != told:
                    raise ValueError(f"a pack was written over dictionary {hashed}, the folder has {told}")
                counts, offsets, body = counts.values.to_numpy(), offsets.values.to_numpy(), body.as_buffer()
                starts = at.as_py() + np.cumsum(counts) - counts
                keep = range(len(counts)) if chosen is None else [i for i, x in enumerate(names.values.to_pylist()) if x in chosen]
                step = max(1, (1 << 22) // max(1, int(counts.mean()) * 4)) if len(counts) else 1
                for a in range(0, len(keep), step):
                    some = keep[a : a + step]
                    ids = [np.frombuffer(reader.decompress(body[offsets[i] : offsets[i + 1]]), f"<u{width.as_py()}").astype("<u4").tobytes() for i in some]
                    row = np.fromiter(some, np.int64, len(some))
                    yield pa.RecordBatch.from_arrays([names.values.take(pa.array(row)), pa.array(starts[row]), pa.array(counts[row]), pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    parts = spark.read.parquet(f"{folder}/parts")
    placed = packs.join(parts, "part").select((F.col("before") + F.col("first")).alias("before"), "ids", "offsets", "counts", "body", "dictionary", "width")
    return placed.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary")
