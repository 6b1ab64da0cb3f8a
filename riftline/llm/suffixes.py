"""Polynomial hashes of byte strings, and a sort of suffixes that compares them by those hashes.

Sums of random words by byte times powers of an odd base, modulo 2^64, give the hash of any substring as a difference
of two prefix sums, divided by a power of the base; it doesn't depend on what stands around the substring.  Two
suffixes are compared by a binary search for the length of their common extension, seven hash comparisons for up to
100 bytes, and by the byte after it.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_240_911)
WORDS = _RANDOM.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
BASES = [int(x) | 1 for x in _RANDOM.integers(2**32, 2**63, size=2)]
STEPS = (64, 32, 16, 8, 4, 2, 1)
#: Bytes of a buffer up to which the hashes of all substrings of those lengths are kept; beyond, they are computed when asked for.
TABLED = 1 << 21


class Hashes:
    """Hashes of the substrings of a buffer, by one of two independent functions."""

    def __init__(self, buffer: np.ndarray, which: int = 0):
        n, base = len(buffer), BASES[which]
        powers, self.back = np.full(n + 1, base, dtype=np.uint64), np.full(n + 1, pow(base, -1, 2**64), dtype=np.uint64)
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(WORDS[which][buffer] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def of_length(self, length: int) -> np.ndarray:
        """The hashes of all substrings of a length, by their start."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n else np.zeros(0, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Suffixes:
    """Suffixes of a buffer, of which the first ``span`` (at most 127) bytes count."""

    def __init__(self, buffer: np.ndarray, span: int):
        self.buffer, self.span = np.concatenate([buffer, np.zeros(128, dtype=np.uint8)]), span
        self.hashes = Hashes(self.buffer)
        self.of_step = {s: self.hashes.of_length(s) for s in STEPS} if len(buffer) <= TABLED else None

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many of the first ``span`` bytes after x and after y are the same, by binary search."""
        n = np.zeros(len(x), dtype=np.int64)
        for s in STEPS:
            if self.of_step:
                a, b = self.of_step[s][x + n], self.of_step[s][y + n]
            else:
                a, b = self.hashes.of(x + n, x + n + s), self.hashes.of(y + n, y + n + s)
            n += s * ((n + s <= self.span) & (a == b))
        return n

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of ``starts`` within their segments (runs of equal numbers): a stable mergesort, all merges of a width at once.

        In a merge each suffix finds its place in the other run by binary search.
        """
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[first, len(starts)])
        order = np.arange(len(starts))
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            at = np.flatnonzero(end - begin > width)
            a, e, r = begin[at], end[at], at - begin[at]
            block = a + r // (2 * width) * (2 * width)
            left = at < block + width
            low = np.where(left, np.minimum(block + width, e), block)
            high = np.where(left, np.minimum(block + 2 * width, e), block + width)
            other, x = low.copy(), starts[order[at]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                mine, theirs = x[open_], starts[order[middle]]
                n = self.common(mine, theirs)
                same = n == self.span
                before = np.where(same, ~left[open_], self.buffer[theirs + n] < self.buffer[mine + n])
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = block + (at - np.where(left, block, block + width)) + (low - other)
            moved = order.copy()
            moved[place] = order[at]
            order, width = moved, 2 * width
        return order

    def ordered(self, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and how many bytes each suffix in it shares with the one before, -1 for the first of a segment.

        Suffixes that share all ``span`` bytes by their hashes are compared byte by byte too.
        """
        order = self.sort(starts, segment)
        a, b = starts[order[:-1]], starts[order[1:]]
        shared = np.where(segment[order[:-1]] == segment[order[1:]], self.common(a, b), -1)
        for some in np.array_split(np.flatnonzero(shared > 0), len(order) // 20_000 + 1):
            n = np.arange(self.span)
            same = (self.buffer[a[some][:, None] + n] == self.buffer[b[some][:, None] + n]) | (n >= shared[some][:, None])
            if not same.all():
                return self.ordered_by_bytes(starts, segment)
        return order, np.r_[-1, shared][: len(order)]

    def ordered_by_bytes(self, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for the case that two strings share one."""
        key = [(g, self.buffer[s : s + self.span].tobytes()) for s, g in zip(starts.tolist(), segment.tolist(), strict=True)]
        order = sorted(range(len(key)), key=key.__getitem__)
        shared = [-1] * len(order)
        for n in range(1, len(order)):
            (g, a), (h, b) = key[order[n - 1]], key[order[n]]
            if g == h:
                shared[n] = next((k for k in range(self.span) if a[k] != b[k]), self.span)
        return np.array(order, dtype=np.int64), np.array(shared, dtype=np.int64)


def classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """By suffix, a number that two have in common if and only if they share ``length`` bytes (and a segment)."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < max(length, 0))
    return out
