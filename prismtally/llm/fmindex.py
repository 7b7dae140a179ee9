"""A compressed FM-index over sequences of numbers, searched for many patterns at once with numpy."""

from __future__ import annotations

import numpy as np

WORD = 64


class BitVector:
    """Packed bits with a count per 64-bit word: 1.5 bits of memory per bit, rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // WORD + 1
        padded = np.zeros(n * WORD, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(n + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:], dtype=np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        inside = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(inside)


class WaveletMatrix:
    """Rank of any symbol before any position in one bit-vector rank per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        rest = symbols
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (rest >> shift & 1).astype(bool)
            zeros = int(len(bits) - np.count_nonzero(bits))
            self.levels.append((shift, BitVector(bits), zeros))
            rest = np.concatenate([rest[~bits], rest[bits]])
        self.start = self.walk(np.zeros(alphabet, np.int64), np.arange(alphabet))

    def walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.walk(at, symbol) - self.start[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` or more symbols, and the common prefixes of neighbours (up to that)."""
    n, rank, span, ranks = len(text), text.astype(np.int64), 1, []
    while True:
        ranks.append((span, rank))
        if span >= depth or int(rank.max(initial=0)) + 1 >= n and len(np.unique(rank)) == n:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - span)] = rank[span:] + 1
        rank = np.unique(rank * (n + 2 + int(text.max(initial=0))) + after, return_inverse=True)[1].astype(np.int64)
        span *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    for length, level in reversed(ranks):
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = level[a[inside]] == level[b[inside]]
        common[1:][same] += length
    return order, common


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest smaller value before (or 0) and behind (or the length)."""
    n, items = len(values), values.tolist()
    before, behind, stack = [0] * n, [n] * n, []
    for i, v in enumerate(items):
        while stack and items[stack[-1]] >= v:
            if items[stack[-1]] > v:
                behind[stack[-1]] = i
            top = stack.pop()
            if items[top] == v:  # equal values share their next smaller one, filled in below
                behind[top] = -i
        before[i] = stack[-1] if stack else 0
        stack.append(i)
    for i in range(n - 1, -1, -1):
        if behind[i] < 0:
            behind[i] = behind[-behind[i]]
    return np.array(before, np.int64), np.array(behind, np.int64)


class FMIndex:
    """An index over ``text`` (symbols from 1 on; 0 separates sequences), each place of which has an ``owner``."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int) -> None:
        n, alphabet = len(text), int(text.max(initial=0)) + 1
        order, common = suffix_order(text, depth)
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.last_column = WaveletMatrix(text[order - 1], alphabet)
        self.common = np.concatenate([common, [0]])
        self.common[0] = 0
        self.before, self.behind = nearest_smaller(np.concatenate([common, [-1]]))
        least = owner[order].astype(np.int32)
        self.least = [least]  # minima of 2^k neighbours
        while 2 * (1 << (len(self.least) - 1)) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][: n - 2 * half + 1], self.least[-1][half : n - half + 1]))

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        size = np.maximum(high - low, 1)
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many ranges."""
        both = self.last_column.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def widened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent interval and the length that all its suffixes share."""
        edge = np.where(self.common[low] >= self.common[high], low, high)
        length = self.common[edge]
        root = length <= 0
        return np.where(root, 0, self.before[edge]), np.where(root, self.n, self.behind[edge]), np.maximum(length, 0)

    def matching_statistics(self, patterns: list[np.ndarray], owners: np.ndarray) -> list[np.ndarray]:
        """For each place of each pattern, the longest match from there on in a sequence of a smaller owner."""
        sizes = np.array([len(p) for p in patterns], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        out = np.zeros(len(flat), np.int64)
        at, length = sizes.copy(), np.zeros(len(sizes), np.int64)
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        live = np.flatnonzero(at > 0)
        while len(live):
            symbol = flat[starts[live] + at[live] - 1]
            lo, hi = self.extended(low[live], high[live], symbol)
            fits = lo < hi
            some = np.flatnonzero(fits)
            fits[some] = self.smallest_owner(lo[some], hi[some]) < owners[live[some]]
            on, off = live[fits], live[~fits]
            low[on], high[on] = lo[fits], hi[fits]
            length[on] += 1
            at[on] -= 1
            out[starts[on] + at[on]] = length[on]
            none = length[off] == 0
            at[off[none]] -= 1  # not even this symbol
            tight = off[~none]
            low[tight], high[tight], length[tight] = self.widened(low[tight], high[tight])
            live = live[at[live] > 0]
        return [out[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
