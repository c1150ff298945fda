"""Suffix sort by prefix hashes, for many suffixes at once.

Two suffixes are compared by the length of what they share, which a binary search over
prefix hashes finds in a number of steps logarithmic in the depth asked for; the byte
after it decides.  Suffixes are merge-sorted bottom up, all runs of a level together:
a suffix's place in the merged run is its place in its own run plus its rank in the
other, and the rank is found by binary search.  Bytes are compared once more for
neighbours that the hashes call equal.
"""

from __future__ import annotations

import numpy as np

from ebbflow.llm.rolling import Powers, U, prefixes

I64 = np.int64


class Text:
    """Bytes with prefix hashes; every suffix asked about must have ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int, powers: Powers):
        self.data, self.depth = data, depth
        self.prefix = prefixes(data.astype(U) + U(1), powers)
        self.down = powers.down
        n = max(0, len(data) - depth + 1)
        self.whole = (self.prefix[depth : depth + n] - self.prefix[:n]) * self.down[:n]

    def words(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes at each place as one number, in the order of the bytes."""
        out = np.zeros(len(at), U)
        for k in range(8):
            out = (out << U(8)) | self.data[at + k].astype(U)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes each two suffixes share, up to the depth."""
        out = np.full(len(a), self.depth, I64)
        differ = np.flatnonzero(self.whole[a] != self.whole[b])
        a, b = a[differ], b[differ]
        low, high = np.zeros(len(a), I64), np.full(len(a), self.depth - 1, I64)
        back_a, back_b, pre_a, pre_b = self.down[a], self.down[b], self.prefix[a], self.prefix[b]
        for _ in range((self.depth - 1).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - pre_a) * back_a == (self.prefix[b + middle] - pre_b) * back_b
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        out[differ] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b, or also where they are equal."""
        shared = self.common(a, b)
        differ = shared < self.depth
        at = np.where(differ, shared, 0)
        return np.where(differ, self.data[a + at] < self.data[b + at], or_equal)


def sort_groups(text: Text, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes at ``starts``, sorted within neighbouring groups of the given sizes."""
    order = starts.copy()
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    width = 1
    open_ = np.flatnonzero(size > 1)
    while len(open_):
        base, total = first[open_], size[open_]
        local = open_ - base
        run = local // width
        own = local - run * width
        other = (run ^ 1) * width
        low = np.minimum(other, total)
        high = np.minimum(other + width, total)
        begin = low.copy()
        right = (run & 1).astype(bool)
        mine = order[open_]
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            theirs = order[base[live] + middle]
            before = text.less(theirs, mine[live], right[live])  # a left run's equals come first
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
            live = live[low[live] < high[live]]
        place = base + (run & ~1) * width + own + (low - begin)
        merged = order.copy()
        merged[place] = mine
        order = merged
        width *= 2
        open_ = open_[total > width]
    return order


def equal_neighbours(text: Text, order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each sorted suffix, whether its group's one before it has the same ``depth`` bytes."""
    equal = np.zeros(len(order), bool)
    inner = np.ones(len(order), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    at = at[text.common(order[at], order[at - 1]) == text.depth]
    for step in range(0, len(at), 100_000):
        part = at[step : step + 100_000]
        spans = np.arange(text.depth)
        equal[part] = (text.data[order[part][:, None] + spans] == text.data[order[part - 1][:, None] + spans]).all(axis=1)
    return equal
