"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are ordered by their first ``depth`` symbols only. That is enough to find every pattern of up to ``depth``
symbols by backward search, and lets a search go on past it: after each further symbol the interval is widened to the
class of suffixes that agree in ``depth`` symbols, which drops the oldest symbol. So one step for each word gives the
matching statistics of a streamed text, capped at ``depth``.
"""

from __future__ import annotations

import numpy as np


def depth_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place the rank of its next ``depth`` symbols; equal runs have equal ranks (prefix doubling)."""
    n = len(symbols)
    rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        other = np.full(n, -1, np.int64)
        other[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + other + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


class WaveletMatrix:
    """rank(symbol, place) over a sequence of numbers, one row of packed bits for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int):
        self.rows = []
        values = values.astype(np.int64)
        for shift in range(bits - 1, -1, -1):
            ones = (values >> shift) & 1
            n = len(ones)
            packed = np.zeros(n // 64 + 2, np.uint64)
            raw = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.rows.append((shift, packed, before, n - int(ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before low and before high."""
        begin = np.zeros_like(low)
        for shift, packed, before, zeros in self.rows:
            one = ((symbol >> shift) & 1).astype(bool)
            low, high, begin = (np.where(one, zeros + ones, at - ones)
                                for at in (low, high, begin) for ones in (self._ones(packed, before, at),))
        return low - begin, high - begin


class FmIndex:
    """The index of several texts of word numbers (1 and more); each text has an owner, and a class its smallest one."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, depth: int):
        """``texts``: the texts one after the other; ``lengths``: theirs."""
        self.depth = depth
        n = len(texts) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.zeros(n, np.int64)  # 0 ends a text
        body = np.ones(n, bool)
        body[ends] = False
        symbols[body] = texts
        owner = np.repeat(owners, lengths + 1)
        rank = depth_ranks(symbols, depth)
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        starts = np.flatnonzero(np.append(True, sorted_rank[1:] != sorted_rank[:-1]))
        self.class_of = np.cumsum(np.append(False, sorted_rank[1:] != sorted_rank[:-1]))
        self.class_start = starts
        self.class_end = np.append(starts[1:], n)
        self.smallest = np.minimum.reduceat(owner[order], starts)
        transform = symbols[order - 1]
        self.size, self.alphabet = n, int(symbols.max(initial=0)) + 1
        self.bits = max(1, self.alphabet.bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        self.wavelet = WaveletMatrix(transform, self.bits)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern for the intervals of the patterns."""
        a, b = self.wavelet.ranks(symbol, low, high)
        base = self.less[symbol]
        return base + a, base + b

    def matching(self, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed texts the matching length to its right, capped at ``depth``, and where that
        is reached the smallest owner of an occurrence (else -1). Texts are one after the other, as in the index.

        A text's symbols that the index does not know must be 0.
        """
        length = np.zeros(len(texts), np.int64)
        first = np.full(len(texts), -1, np.int64)
        ends = np.cumsum(lengths)
        live = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        matched = np.zeros(len(lengths), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[lengths[live] >= back]
            at = ends[live] - back
            symbol = texts[at]
            a, b = self.extend(low[live], high[live], symbol)
            dead = (a >= b) | (symbol == 0)
            if dead.any():  # shorter matches: search anew from the left end of the window, symbol by symbol
                for i in np.flatnonzero(dead).tolist():
                    a[i], b[i], matched[live[i]] = self._shorter(texts, at[i], ends[live[i]])
            alive = ~dead
            matched[live[alive]] += 1
            full = matched[live] >= self.depth
            matched[live[full]] = self.depth
            if full.any():
                group = self.class_of[a[full]]
                a[full], b[full] = self.class_start[group], self.class_end[group]
                first[at[full]] = self.smallest[group]
            low[live], high[live] = a, b
            length[at] = matched[live]
        return length, first

    def _shorter(self, texts: np.ndarray, at: int, end: int) -> tuple[int, int, int]:
        """The longest prefix of texts[at:end], at most ``depth`` long, that occurs: its interval and length."""
        low_bound, high_bound, best = 0, min(self.depth, end - at), (0, self.size, 0)
        while low_bound < high_bound:  # prefixes of a text that occurs occur as well
            half = (low_bound + high_bound + 1) // 2
            low, high = np.array([0]), np.array([self.size])
            for symbol in texts[at : at + half][::-1]:
                low, high = self.extend(low, high, np.array([symbol])) if symbol else (low, low)
                if low[0] >= high[0]:
                    break
            if low[0] < high[0]:
                low_bound, best = half, (int(low[0]), int(high[0]), half)
            else:
                high_bound = half - 1
        return best
