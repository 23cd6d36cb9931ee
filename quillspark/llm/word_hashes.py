"""Words of an Arrow string column as bytes and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: An odd multiplier and two odd mixers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes of text that are hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


#: The characters of words: all but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Block(NamedTuple):
    """Some texts of a column. Word k is data[first[k]:last[k]]; text i of the block has the words bounds[i] to bounds[i + 1]."""

    at: int
    data: np.ndarray
    inside: np.ndarray
    first: np.ndarray
    last: np.ndarray
    bounds: np.ndarray


def text_blocks(column: pa.Array, solid: np.ndarray = SOLID, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of a column's texts of about `size` bytes, in order. solid tells the bytes of words; lower takes A-Z as a-z. Null has no words."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        edges = offsets[at : to + 1] - offsets[at]
        block = data[offsets[at] : offsets[to]]
        if lower:
            block = LOWER[block]
        inside = solid[block]
        border = np.zeros(len(block) + 1, bool)
        border[edges] = True
        gap = np.concatenate(([True], ~inside, [True]))
        first = np.flatnonzero(inside & (gap[:-2] | border[:-1]))
        last = np.flatnonzero(inside & (gap[2:] | border[1:])) + 1
        yield Block(at, block, inside, first, last, np.searchsorted(first, edges))
        at = to


def hash_words(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of data[first:last] for each pair: eight bytes at a time are mixed into a state that began with the length.

    Each step is a bijection of 64 bits that isn't linear, so words that differ meet only by chance.
    """
    h = mixed((last - first).astype(np.uint64) * BASE)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for k in np.flatnonzero(last - first > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[first[k] : last[k]].tobytes())
    who = np.flatnonzero(last - first <= LONG_WORD)
    at, end = first[who], last[who]
    while len(who):
        h[who] = mixed(h[who] ^ (eight[at] & _LEFT[np.minimum(end - at, 8)]))
        more = end - at > 8
        who, at, end = who[more], at[more] + 8, end[more]
    return h


def run_hashes(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A hash of the runs values[first:first + size]."""
    h = np.full(len(first), size, np.uint64)
    for k in range(size):
        h = (h ^ values[first + k]) * BASE
        h ^= h >> np.uint64(29)
    return mixed(h)


def word_blocks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, bounds) of blocks of a column's texts; text k of a block has the words bounds[k] to bounds[k + 1]. Words are parted by ASCII white space."""
    for b in text_blocks(column, SOLID, lower):
        yield b.at, hash_words(b.data, b.first, b.last), b.bounds


def joined_words(b: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block with one space between the words of a text: (bytes, first, last)."""
    ends = b.last[b.last < len(b.data)]
    ends = ends[~b.inside[ends]]
    keep = b.inside.copy()
    keep[ends] = True
    data = b.data.copy()
    data[ends] = 32
    place = np.cumsum(keep) - 1
    return data[keep].tobytes(), place[b.first], place[b.last - 1] + 1
