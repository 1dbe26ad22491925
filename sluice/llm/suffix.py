"""Hash-compared suffix sort: prefix polynomial hashes and binary search find how far
two suffixes agree, so that a merge sort compares them in logarithmic time."""

from __future__ import annotations

import numpy as np

BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: What each byte counts: odd, drawn once.
BYTE = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


class Hashes:
    """Polynomial hashes, modulo 2**64, of any stretches of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.of(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        values = BYTE[data]
        values *= up[:-1]
        np.cumsum(values, out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        h = self.prefix[start + length]
        h -= self.prefix[start]
        h *= self.down[start]
        return h

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all stretches of one width."""
        h = self.prefix[width:] - self.prefix[:-width]
        h *= self.down[: len(h)]
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def common(hashes: Hashes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes the suffixes at x and y share, at most limit, by binary search."""
    out = np.full(len(x), limit, np.int64)
    todo = np.flatnonzero(hashes.of(x, limit) != hashes.of(y, limit))
    low, high = np.zeros(len(todo), np.int64), np.full(len(todo), limit - 1, np.int64)
    a, b = x[todo], y[todo]
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    out[todo] = low
    return out


def before(data: np.ndarray, hashes: Hashes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Whether the suffix at x is less than the one at y within limit bytes."""
    shared = common(hashes, x, y, limit)
    differ = shared < limit
    at = np.minimum(shared, limit - 1)
    return differ & (data[x + at] < data[y + at])


def sort_suffixes(data: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Merge sort, stable, of the suffixes at starts by their first limit bytes within
    runs of equal groups. Returns the order of the given positions."""
    n = len(starts)
    order = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    begin, length = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(n) - begin
    run = 1
    while (length > run).any():
        side = (place // run) & 1
        pair = place - place % (2 * run)  # where both runs begin, within the group
        other = np.where(side == 0, pair + run, pair)
        count = np.clip(length - other, 0, run)
        todo = np.flatnonzero(count > 0)
        low, high = np.zeros(len(todo), np.int64), count[todo].copy()
        base, mine = (begin + other)[todo], starts[order[todo]]
        right = side[todo] == 1
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            theirs = starts[order[base[open_] + middle]]
            # a right element goes after equal left ones, a left one before equal right ones
            r = right[open_]
            less = np.empty(len(open_), bool)
            a, b = mine[open_], theirs
            less[~r] = before(data, hashes, b[~r], a[~r], limit)
            less[r] = ~before(data, hashes, a[r], b[r], limit)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        target = np.arange(n)
        target[todo] = begin[todo] + pair[todo] + (place[todo] % run) + low
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        run *= 2
    return order


def equal_to_previous(data: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Of sorted suffixes: whether each shares limit bytes with the one before in its
    group; what the hashes say is verified byte by byte."""
    same = np.zeros(len(starts), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    near = near[hashes.of(starts[near], limit) == hashes.of(starts[near - 1], limit)]
    steps = np.arange(limit)
    for i in range(0, len(near), 1 << 14):
        part = near[i : i + (1 << 14)]
        same[part] = (data[starts[part][:, None] + steps] == data[starts[part - 1][:, None] + steps]).all(1)
    return same
