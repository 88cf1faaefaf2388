"""A compressed FM-index over word sequences: packed wavelet matrix, backward search, matching statistics.

All searches advance together, one numpy step for every sequence still under way.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a prefix, from one packed bit row per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32)
            self.levels.append((bit, words, before, int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi."""
        n = len(lo)
        at = np.concatenate([np.zeros(n, np.int64), lo, hi])
        symbol = np.concatenate([symbol, symbol, symbol])
        for bit, words, before, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at[n : 2 * n] - at[:n], at[2 * n :] - at[:n]


class FMIndex:
    """Index of integer sequences (symbols from 1) with suffixes ordered by more than their first `longest` symbols.

    Patterns of up to `longest` symbols have exact intervals. Sequences are kept apart by the symbol 0.
    """

    def __init__(self, sequences: list[np.ndarray], longest: int):
        text = np.concatenate([np.concatenate([s, [0]]) for s in sequences]).astype(np.int64)
        n = self.n = len(text)
        ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while step <= longest:
            last = ranks[-1]
            key = last * (n + 1)
            key[: max(0, n - step)] += last[step:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            ranks.append(rank)
            step *= 2
        # common prefixes of neighbours, capped: from the largest step down
        left, right, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for power in range(len(ranks) - 2, -1, -1):
            ok = (left < n) & (right < n)
            same = np.zeros(n - 1, bool)
            same[ok] = ranks[power][left[ok]] == ranks[power][right[ok]]
            jump = same * (1 << power)
            left, right, shared = left + jump, right + jump, shared + jump
        self.lcp = np.concatenate([[0], shared, [0]]).astype(np.int8 if step <= 64 else np.int32)
        self.mins = [self.lcp]
        while 2 << (len(self.mins) - 1) <= n + 1:
            half, width = self.mins[-1], 1 << (len(self.mins) - 1)
            self.mins.append(np.minimum(half[:-width], half[width:]))
        bwt = text[order - 1]
        size = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting a symbol before the patterns of [lo, hi)."""
        a, b = self.tree.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns' first `length` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for power in range(len(self.mins) - 1, -1, -1):
            table, width = self.mins[power], 1 << power
            ok = hi < len(table)
            hi[ok] += width * (table[hi[ok]] >= length[ok])
            start = lo - width + 1
            ok = start >= 0
            lo[ok] -= width * (table[start[ok]] >= length[ok])
        return lo, hi

    def repeated_windows(self, sequences: list[np.ndarray], window: int) -> list[np.ndarray]:
        """For each sequence the starts of its windows that the index holds at least twice.

        Matching statistics from right to left: the match is extended by the symbol before it while at least two
        suffixes have it, else it gives up symbols on its right; it never needs to be longer than the window.
        """
        out: list[list[int]] = [[] for _ in sequences]
        sizes = np.array([len(s) for s in sequences], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
        which = np.flatnonzero(sizes >= window)
        at, length = sizes[which], np.zeros(len(which), np.int64)
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(which):
            new_lo, new_hi = self.extend(flat[base[which] + at - 1], lo, hi)
            good = new_hi - new_lo >= 2
            lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
            skip = ~good & (length == 0)
            at, length = at - (good | skip), length + good
            full = good & (length == window)
            if full.any():
                hits.append((which[full], at[full]))
            shorter = ~good & ~skip
            change = shorter | full
            if change.any():
                a, b = lo[change], hi[change]
                less = np.maximum(self.lcp[a], self.lcp[b]).astype(np.int64)
                less = np.where(full[change], window - 1, np.minimum(less, length[change] - 1))
                a, b = self.widen(a, b, less)
                lo[change], hi[change], length[change] = np.where(less > 0, a, 0), np.where(less > 0, b, self.n), less
            alive = (at > 0) & (at + length >= window)
            if not alive.all():
                which, at, length, lo, hi = which[alive], at[alive], length[alive], lo[alive], hi[alive]
        for owners, starts in hits:
            for owner, start in zip(owners.tolist(), starts.tolist(), strict=True):
                out[owner].append(start)
        return [np.array(sorted(x), np.int64) for x in out]
