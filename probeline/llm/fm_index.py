"""An FM-index over a sequence of word codes."""

from __future__ import annotations

import numpy as np

#: Every so many text positions are sampled for locating; so is each position after a separator.
SAMPLE = 16


def suffix_order(symbols: np.ndarray, width: int) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 is a separator: each one differs from all others and they sort by
    position, after the words, so comparison never runs past one. Only suffixes still tied are sorted again. The last symbol must be a
    separator."""
    n = len(symbols)
    first = symbols.astype(np.int64)
    gaps = np.flatnonzero(symbols == 0)
    first[gaps] = width + np.arange(len(gaps))
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = ~head | ~np.concatenate((head[1:], [True]))
    place = np.flatnonzero(tied)
    step = 1
    while len(place):
        own = order[place]
        key = rank[own] * n + rank[own + step]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[place] = own
        head = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
        rank[own] = place[start]
        place = place[~head | ~np.concatenate((head[1:], [True]))]
        step *= 2
    return order


class Bits:
    """A bitmap with ranks: counts before each 64-bit word, and a population count inside it."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Symbols as one bitmap per bit, highest first; each level keeps the zeros before the ones."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, int(width).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append((Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` comes to lie when only ``symbols`` are followed down."""
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbols >> (self.depth - 1 - k) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and where those positions come to lie."""
        out = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            out = out << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return out, at


class FmIndex:
    """Index of ``symbols``: 0 separates, 1 to ``width`` are words."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.symbols_before = np.zeros(width + 2, np.int64)
        n = len(symbols)
        order = suffix_order(symbols, width + 1)
        last = symbols[order - 1]  # the last symbol, a separator, stands before the first
        self.wavelet = Wavelet(last.astype(np.int64), width)
        # words come first in suffix order, then separators; symbol 0 is never searched
        counts = np.bincount(symbols, minlength=width + 1)
        self.symbols_before[2:] = np.cumsum(counts[1:])
        self.origin = self.wavelet.place(np.arange(width + 1), np.zeros(width + 1, np.int64))
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.marked = Bits(sampled)
        self.samples = order[sampled]
        self.size = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once; rows of suffix order, ends exclusive."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for back in range(patterns.shape[1] if len(patterns) else 0):
            live = np.flatnonzero((back < lengths) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - back]
            base = self.symbols_before[symbol] - self.origin[symbol]
            low[live] = base + self.wavelet.place(symbol, low[live])
            high[live] = base + self.wavelet.place(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the text until a sampled one."""
        out, walked = np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked.get(rows)
            out[todo[hit]] = self.samples[self.marked.rank(rows[hit])] + walked
            todo, rows = todo[~hit], rows[~hit]
            symbol, place = self.wavelet.get(rows)
            rows = self.symbols_before[symbol] - self.origin[symbol] + place
            walked += 1
        return out
