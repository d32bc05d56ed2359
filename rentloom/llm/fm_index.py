"""An FM-index over a sequence of small numbers, in numpy.

The sequence is cut into runs by 0, which no pattern contains. Its suffixes are sorted, a 0 ending the comparison; the
symbols before the sorted suffixes (the Burrows-Wheeler transform) are held in a wavelet matrix. A pattern's rows are
found backwards, symbol by symbol, from ranks alone; a row's place in the sequence is found by going back through the
transform to the next sampled one. Many patterns or rows are handled at a time.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
U = np.uint64


class Bits:
    """A bit vector that counts its ones up to a place: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.total = int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << bit) - U(1)))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(U)) & U(1)).astype(np.int64)


class WaveletMatrix:
    """A level for each bit of the symbols, the highest first; behind each level symbols with a 0 there come first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for b in reversed(range(bits)):
            ones = (symbols >> b) & 1 == 1
            self.levels.append((b, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often a symbol stands before each of the places."""
        at = [np.zeros(len(symbol), np.int64), *places]
        for b, bits, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            for k, i in enumerate(at):
                ones = bits.ones(i)
                at[k] = np.where(one, zeros + ones, i - ones)
        return [i - at[0] for i in at[1:]]

    def symbols(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one = bits[i]
            out |= one << b
            ones = bits.ones(i)
            i = np.where(one == 1, zeros + ones, i - ones)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes' begins in order; each 0 is a symbol of its own, the earlier the smaller. Ranks are doubled in length
    each round, of suffixes that aren't told apart yet only."""
    n = len(symbols)
    zero = symbols == 0
    key = np.where(zero, np.cumsum(zero), symbols.astype(np.int64) + int(zero.sum()))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    length = 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        # A suffix that isn't told apart goes on for length symbols without a 0, so the next place is there.
        own, following = rank[open_], rank[open_ + length]
        turn = np.argsort(own * n + following)
        open_, own, following = open_[turn], own[turn], following[turn]
        at = np.arange(len(open_))
        group = np.ones(len(open_), bool)
        group[1:] = own[1:] != own[:-1]
        new = group.copy()
        new[1:] |= following[1:] != following[:-1]
        base = at[group][np.cumsum(group) - 1]
        rank[open_] = own + at[new][np.cumsum(new) - 1] - base
        length *= 2
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """symbols: whole numbers, 0 between runs and at the end; at most ``most`` is the greatest."""

    def __init__(self, symbols: np.ndarray, most: int, sample: int = SAMPLE):
        self.n = len(symbols)
        assert self.n and symbols[-1] == 0
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))]).astype(np.int64)
        self.matrix = WaveletMatrix(before.astype(np.int64), max(1, int(most).bit_length()))
        # Begins of runs are sampled too, so going back never crosses a 0.
        taken = (order % sample == 0) | (before == 0)
        self.taken, self.places = Bits(taken), order[taken]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each pattern; patterns are rows of symbols from 1 on, all of one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        left = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[left, k].astype(np.int64)
            a, b = self.matrix.ranks(c, low[left], high[left])
            low[left], high[left] = self.less[c] + a, self.less[c] + b
            gone = left[a == b]
            low[gone] = high[gone] = 0
            left = left[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the rows' suffixes begin."""
        out = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            known = self.taken[rows] == 1
            out[left[known]] = self.places[self.taken.ones(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            c = self.matrix.symbols(rows)
            (r,) = self.matrix.ranks(c, rows)
            rows, steps = self.less[c] + r, steps + 1
        return out
