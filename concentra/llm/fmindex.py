"""A full-text index over sequences of words: suffix array order, the Burrows-Wheeler
transform in a wavelet matrix of packed bit vectors with rank counts, and backward
search, all for many queries at once. It is not compressed: the suffix order, the
owners and the doubling ranks are kept beside the matrix."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(-(-(n + 1) // 64) * 8, np.uint8)
        packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Occurrences of a symbol among the first i of a sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            vector = BitVector(bit)
            self.bits.append(vector)
            self.zeros.append(len(symbols) - vector.ones)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for depth, (vector, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = symbol >> (self.levels - 1 - depth) & 1
            rank = vector.rank(i)
            i = np.where(one == 1, zeros + rank, i - rank)
        return i

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self.first[symbol]


class FMIndex:
    """Index over segments of words. Segment s is ``words[first[s]:first[s + 1]]``
    and belongs to ``owner[s]``."""

    def __init__(self, words: np.ndarray, first: np.ndarray, owner: np.ndarray):
        n_segments, size = len(first) - 1, np.diff(first)
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        n = len(words) + n_segments
        segment = np.repeat(np.arange(n_segments), size)
        # a separator, symbol 0, closes each segment; separators differ in rank only
        text = np.zeros(n, np.int64)
        text[np.arange(len(words)) + segment] = symbol + 1
        self.symbols = len(self.alphabet) + 1
        ends = first[1:] + np.arange(n_segments)
        rank = text + n_segments
        rank[ends] = np.arange(n_segments)
        self.ranks = [rank]  # ranks by the first 1, 2, 4, ... symbols
        order, width, longest = np.argsort(rank, kind="stable"), 1, int(size.max(initial=0)) + 1
        while width < longest:
            order, rank = self._refine(rank, rank, width)
            self.ranks.append(rank)
            width *= 2
        self.order = order
        self.n = n
        self.owner = np.append(np.repeat(owner, size + 1), 0)[:n]
        previous = text[order - 1]  # of position 0 it is the last separator
        self.wavelet = WaveletMatrix(previous, self.symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self._depths: dict[int, tuple] = {}

    @staticmethod
    def _refine(rank, other, shift):
        """Order and dense ranks by (rank[i], other[i + shift])."""
        n = len(rank)
        second = np.zeros(n, np.int64)
        second[: n - shift] = other[shift:] + 1
        key = rank * (int(other.max(initial=0)) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(new) - 1
        return order, out

    def depth(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(block of each place of the order, first place of each block and n) where
        a block holds the suffixes with the same first ``length`` symbols."""
        if length not in self._depths:
            k = int(length).bit_length() - 1
            rank = self.ranks[min(k, len(self.ranks) - 1)]
            width = 1 << min(k, len(self.ranks) - 1)
            if width < length:
                _, rank = self._refine(rank, rank, length - width)
            rank = rank[self.order]
            new = np.ones(self.n, np.int64)
            new[1:] = rank[1:] != rank[:-1]
            self._depths[length] = np.cumsum(new) - 1, np.append(np.flatnonzero(new), self.n)
        return self._depths[length]

    def least_owner(self, length: int) -> np.ndarray:
        """Smallest owner of each block of the depth."""
        _, first = self.depth(length)
        return np.minimum.reduceat(self.owner[self.order], first[:-1])

    def extend(self, symbol, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the places of symbol + what [lo, hi) matches."""
        base = self.starts[symbol]
        return base + self.wavelet.occurrences(symbol, lo), base + self.wavelet.occurrences(symbol, hi)

    def matching_statistics(self, words: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """For every word of the query sequences the length of the longest match
        that starts there (up to ``longest``) and the first place of its interval.
        All queries go from their last word to their first, one step at a time."""
        at = np.searchsorted(self.alphabet, words)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == words[known]
        symbol = np.where(known, at + 1, 0)
        size = np.diff(first)
        length_out, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        by_size = np.argsort(-size, kind="stable")
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        ordered = -size[by_size]
        for step in range(int(size.max(initial=0))):
            q = by_size[: int(np.searchsorted(ordered, -step, "left"))]  # longer than step
            p = first[q + 1] - 1 - step
            c = symbol[p]
            todo = np.arange(len(q))
            l, h, n = lo[q], hi[q], length[q]
            l[c == 0], h[c == 0], n[c == 0] = 0, self.n, 0
            todo = todo[c > 0]
            while len(todo):
                full = todo[n[todo] == longest]  # make room: drop the last word of the match
                self._shorten(full, l, h, n)
                a, b = self.extend(c[todo], l[todo], h[todo])
                ok = b > a
                done, rest = todo[ok], todo[~ok]
                l[done], h[done] = a[ok], b[ok]
                n[done] += 1
                rest = rest[n[rest] > 0]
                self._shorten(rest, l, h, n)
                todo = rest
            lo[q], hi[q], length[q] = l, h, n
            length_out[p], place[p] = n, l
        return length_out, place

    def _shorten(self, which, lo, hi, length) -> None:
        """Widen intervals to matches that are one word shorter."""
        length[which] -= 1
        for d in np.unique(length[which]).tolist():
            some = which[length[which] == d]
            if d == 0:
                lo[some], hi[some] = 0, self.n
            else:
                block, first = self.depth(d)
                b = block[lo[some]]
                lo[some], hi[some] = first[b], first[b + 1]
