"""A compressed full-text index over one shard of word sequences, in NumPy: BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol before any place of a sequence, from packed bit planes and counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        rows = symbols.astype(np.uint32)
        pad = -(-(len(rows) + 1) // 64) * 64
        for level in range(self.levels - 1, -1, -1):
            bits = (rows >> np.uint32(level) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(np.concatenate((bits, np.zeros(pad - len(bits), np.uint8))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(bits) - bits.sum()))
            rows = np.concatenate((rows[bits == 0], rows[bits == 1]))
        self.first = self._descend(np.arange(top + 1, dtype=np.uint32), np.zeros(top + 1, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbols >> np.uint32(level) & np.uint32(1) == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by prefix doubling. Separators are unique, so it ends within the longest segment."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[: max(len(rank) - k, 0)] = rank[k:] + 1
        pair = rank * (len(rank) + 2) + after
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(rank):
            return np.argsort(rank, kind="stable")
        k *= 2


class ShardIndex:
    """The index of several segments of word numbers, over symbols of q words each.

    A segment is laid out as q sequences, one for each phase: the symbols at places p, p + q, p + 2q, ... So q * k words
    from any place are k symbols in a row, and a search takes k steps. Separators stand between sequences.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, q: int):
        self.q = q
        self.starts = np.cumsum(lengths) - lengths
        symbols, have = words.astype(np.int64), 1
        while have < q:  # numbers of 2, 3, 4 words in a row from those of fewer
            more = min(have, q - have)
            pair = symbols[: len(symbols) - more] * (int(symbols.max(initial=0)) + 1) + symbols[more:]
            symbols, have = np.unique(pair, return_inverse=True)[1], have + more
        segment = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(words)) - self.starts[segment]
        at = np.flatnonzero(offset + q <= lengths[segment])  # a symbol lies within its segment
        phase = segment[at] * q + offset[at] % q
        order = np.lexsort((offset[at], phase))
        at, phase = at[order], phase[order]
        lane = np.cumsum(np.concatenate(([0], phase[1:] != phase[:-1]))) if len(at) else phase
        lanes = int(lane[-1]) + 1 if len(at) else 0
        here = np.arange(len(at)) + lane  # a separator after each sequence
        size = len(at) + lanes
        self.top = int(symbols[at].max(initial=-1)) + 1
        self.symbols = np.zeros(size, np.uint32)
        self.symbols[here] = symbols[at] + 1
        self.row = np.full(len(words), -1, np.int64)
        self.row[at] = here
        word_at = np.full(size, len(words), np.int64)
        word_at[here] = at
        text = self.symbols.astype(np.int64) + lanes
        gaps = np.ones(size, bool)
        gaps[here] = False
        text[gaps] = np.arange(lanes)
        suffixes = suffix_array(text)
        self.place = word_at[suffixes]
        self.less = lanes + np.concatenate(([0], np.cumsum(np.bincount(self.symbols[here], minlength=self.top + 1))[:-1]))
        self.bwt = WaveletMatrix(self.symbols[suffixes - 1], self.top)

    def repeats(self, places: np.ndarray, length: int) -> np.ndarray:
        """For windows of `length` words (a multiple of q) at places of the words: the earliest place that reads the same.

        Matching statistics by backward search, capped at `length`: a window leaves the search once its interval holds one
        suffix, as its match then ends below the cap. Equal windows share an interval, so minima are taken once for each.
        """
        earliest = places.copy()
        which = np.arange(len(places))
        rows = self.row[places]
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(self.symbols), np.int64)
        for back in range(length // self.q - 1, -1, -1):
            symbols = self.symbols[rows[which] + back]
            ranks = self.bwt.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
            lo, hi = self.less[symbols] + ranks[: len(which)], self.less[symbols] + ranks[len(which) :]
            many = hi - lo > 1
            which, lo, hi = which[many], lo[many], hi[many]
            if not len(which):
                return earliest
        begins, which_of = np.unique(lo, return_inverse=True)
        ends = np.zeros(len(begins), np.int64)
        ends[which_of] = hi
        edges = np.stack((begins, ends), axis=1).ravel()
        earliest[which] = np.minimum.reduceat(np.append(self.place, len(self.row)), edges)[::2][which_of]
        return earliest
