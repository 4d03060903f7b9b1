"""An FM-index over word ids: suffix order, wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from .textops import ragged


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Zeros end a suffix: they are below all words, and differ by place.

    Suffixes are sorted by as many symbols as fit in 62 bits, then by doubling, where only groups that
    are still tied are sorted again. Ties that reach a zero are in order of place already.
    """
    n = len(symbols)
    base = int(symbols.max(initial=0)) + 1
    depth = max(1, int(62 / np.log2(base + 1)))
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    padded = np.r_[symbols.astype(np.int64), np.zeros(depth, np.int64)]
    for j in range(depth):
        now = padded[j : j + n]
        key = key * base + np.where(alive, now, 0)
        alive &= now > 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]] | ~alive[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = ~fresh
    tied[:-1] |= tied[1:]
    places = np.flatnonzero(tied)
    while len(places):
        starts = order[places]
        group = rank[starts]
        after = starts + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((second, group))
        starts, group, second = starts[again], group[again], second[again]
        order[places] = starts
        new_group = np.r_[True, group[1:] != group[:-1]]
        new = new_group | np.r_[True, second[1:] != second[:-1]]
        rank[starts] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        tied = ~new
        tied[:-1] |= tied[1:]
        places = places[tied]
        depth *= 2
    return order


class Bits:
    """A bit row with ranks: how many ones lie before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        row = np.zeros(n * 64, bool)
        row[: len(bits)] = bits
        self.words = np.packbits(row, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    """Counts and places of word sequences within ``symbols`` (0: no word that is ever asked for)."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        symbols = np.r_[0, symbols, 0]
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.size = len(symbols)
        self.below = np.r_[0, np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 1))]
        self.levels: list[tuple[int, Bits, int]] = []
        row = last
        for bit in range(int(symbols.max()).bit_length() - 1, -1, -1):
            ones = (row >> bit) & 1 > 0
            self.levels.append((bit, Bits(ones), len(row) - int(ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
        kept = (order % sample == 0) | (last == 0)
        self.marked = Bits(kept)
        self.sampled = order[kept]

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol lies before each of the places in the last column."""
        at = [np.zeros_like(places[0]), *places]
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 > 0
            for k, x in enumerate(at):
                r = ones.rank(x)
                at[k] = np.where(one, zeros + r, x - r)
        return [x - at[0] for x in at[1:]]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase, by backward search. phrases: rows of ids."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            known = symbol < len(self.below) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            a, b = self.ranks(symbol, low[live], high[live])
            low[live], high[live] = self.below[symbol] + a, self.below[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``symbols`` of the given suffixes: back to the nearest sampled one, counting steps."""
        out, rows, who, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(rows):
            there = self.marked.get(rows)
            out[who[there]] = self.sampled[self.marked.rank(rows[there])] + steps
            rows, who = rows[~there], who[~there]
            symbol, at, zero = np.zeros(len(rows), np.int64), rows, np.zeros(len(rows), np.int64)
            for bit, ones, zeros in self.levels:
                one = ones.get(at)
                symbol |= one.astype(np.int64) << bit
                r, s = ones.rank(at), ones.rank(zero)
                at, zero = np.where(one, zeros + r, at - r), np.where(one, zeros + s, zero - s)
            rows = self.below[symbol] + at - zero
            steps += 1
        return out - 1

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence of every phrase."""
        low, high = self.search(phrases, lengths)
        count = np.maximum(high - low, 0)
        return np.repeat(np.arange(len(phrases)), count), self.locate(np.repeat(low, count) + ragged(count))
