"""Enhanced suffix array of a shard of byte strings, and its common-prefix intervals.

The array is built by prefix doubling over packed words, which is a handful of integer sorts. The LCP values of
neighbours come from the ranks of the doubling levels. A stack scan over the LCP values then walks the interval
tree bottom-up; an interval is a maximal repeat when the bytes to the left of its suffixes differ.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # never part of UTF-8; followed by the string's number it keeps strings apart
_PAD = 8


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    s = keys[order]
    step = np.zeros(len(keys), np.int64)
    step[1:] = s[1:] != s[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


class SuffixArray:
    """Suffixes of ``strings`` that start in their first ``starts[i]`` places, in lexicographic order.

    order   places in the joined text, sorted
    lcp     common prefix of order[i-1] and order[i], within their strings (0 for i = 0)
    string  the string of each sorted suffix; place its start in that string
    left    byte before each suffix, or a negative number unlike any other at a string's start
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray):
        k = len(offsets) - 1
        lengths = np.diff(offsets)
        begin = offsets[:-1] + _PAD * np.arange(k)
        n = int(offsets[-1]) + _PAD * k
        text = np.empty(n, np.uint8)
        text[np.arange(len(data)) + _PAD * np.repeat(np.arange(k), lengths)] = data
        tail = (begin + lengths)[:, None] + np.arange(_PAD)
        text[tail] = np.arange(k, dtype=">u8").view(np.uint8).reshape(k, _PAD)
        text[begin + lengths] = SEPARATOR
        packed = np.zeros(n, np.uint64)
        for j in range(8):
            packed[: n - j] |= text[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
        longest = int(lengths.max(initial=0))
        levels = []
        depth = 8
        order, rank = _dense(packed)
        while True:
            levels.append((depth, rank))
            if depth > longest or rank[order[-1]] == n - 1:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = rank[depth:] + 1 if depth < n else 0
            order, rank = _dense(rank * (n + 1) + ahead)
            depth *= 2
        wanted = np.zeros(n, bool)
        owner = np.repeat(np.arange(k), lengths + _PAD)
        inner = np.arange(n) - begin[owner]
        wanted[:] = inner < starts[owner]
        order = order[wanted[order]]
        self.order, self.string, self.place = order, owner[order], inner[order]
        remain = lengths[self.string] - self.place
        a, b = order[:-1], order[1:]
        lcp = np.zeros(len(a), np.int64)
        for depth, rank in reversed(levels):
            x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
            lcp += depth * (rank[x] == rank[y])
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        differ = packed[x] ^ packed[y]
        for j in range(8):
            lcp += (differ >> np.uint64(56 - 8 * j)) == 0
        self.lcp = np.zeros(len(order), np.int64)
        np.minimum(np.minimum(lcp, remain[:-1]), remain[1:], out=self.lcp[1:])
        self.left = np.where(self.place == 0, -1 - self.string, text[np.maximum(order - 1, 0)].astype(np.int64))
        self.text = text

    def intervals(self, least: int):
        """(length, first, last) of every left-diverse common-prefix interval of ``least`` or more, inner ones first."""
        lcp, left = self.lcp, self.left
        long = lcp >= least
        if not long.any():
            return
        edge = np.diff(np.concatenate(([False], long, [False])).astype(np.int8))
        for first, last in zip((np.flatnonzero(edge == 1) - 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()):
            part = left[first : last + 1]
            if (part == part[0]).all():
                continue  # every interval inside extends to the left, and is found from there
            yield from self._scan(lcp[first + 1 : last + 1].tolist(), part.tolist(), first)

    @staticmethod
    def _scan(lcp: list[int], left: list[int], base: int):
        """Stack scan of one run: an entry is [lcp value, first suffix, the single left byte or None if diverse]."""
        stack: list[list] = []
        for i, depth in enumerate([*lcp, 0]):
            first, seen = i, left[i]
            while stack and stack[-1][0] > depth:
                value, first, have = stack.pop()
                seen = have if have == seen else None
                if seen is None:
                    yield value, base + first, base + i
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != seen:
                    stack[-1][2] = None
            elif depth:
                stack.append([depth, first, seen])


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Every maximal repeat of ``least`` bytes or more in ``strings``, with all its (string, place) occurrences."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    if not offsets[-1]:
        return []
    sa = SuffixArray(np.frombuffer(b"".join(strings), np.uint8), offsets, np.diff(offsets))
    out = []
    for length, a, b in sa.intervals(least):
        at = sorted(zip(sa.string[a : b + 1].tolist(), sa.place[a : b + 1].tolist()))
        i, p = at[0]
        out.append((strings[i][p : p + length], at))
    return out


def longest_cover(sa: SuffixArray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted suffix, the length of the longest maximal repeat it starts (0: none), and that one's interval."""
    best = np.zeros(len(sa.order), np.int64)
    group = np.full(len(sa.order), -1, np.int64)
    for length, a, b in sa.intervals(least):
        part = best[a : b + 1]
        free = part == 0
        part[free] = length
        group[a : b + 1][free] = a
    return best, group
