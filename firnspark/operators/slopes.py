"""Slopes of given ranks among all pairs of points, without building the pairs: ranks of a slope are counted as inversions.

Of two points with x1 < x2 the slope is below s exactly if y - s x falls from the first to the second. So the number of slopes below s is that of the
inversions of y - s x in the order of x, and slopes between two values belong to the pairs whose order differs between the two.
"""

from __future__ import annotations

import numpy as np

#: Pairs up to which all slopes are built and sorted.
FEW_PAIRS = 1 << 16
#: Random pairs that narrow the search at first.
SAMPLE = 1 << 14


def _merges(ranks: np.ndarray):
    """Sorted halves of a permutation from the bottom up: for each width the left and right halves, of which blocks are rows. What is
    added to fill the last block is larger than all before it and so inverts nothing."""
    n = len(ranks)
    size = 1 << max(1, (n - 1).bit_length())
    held = np.concatenate([ranks, np.arange(n, size)])
    width = 1
    while width < size:
        blocks = held.reshape(-1, 2 * width)
        yield blocks[:, :width], blocks[:, width:], size
        held = np.sort(blocks, axis=1).ravel()
        width *= 2


def _smaller(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For each element of a right half how many of its left half are smaller."""
    row = (np.arange(len(left)) * size)[:, None]
    return np.searchsorted((left + row).ravel(), (right + row).ravel()).reshape(right.shape) - np.arange(len(left))[:, None] * left.shape[1]


def inversions(ranks: np.ndarray) -> int:
    return sum(int((left.shape[1] - _smaller(left, right, size)).sum()) for left, right, size in _merges(ranks))


def inverted_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All inversions, as pairs of values (larger, smaller)."""
    big, small = [], []
    for left, right, size in _merges(ranks):
        first = _smaller(left, right, size)
        many = left.shape[1] - first
        block, column = np.nonzero(many)
        n = many[block, column]
        at = np.repeat(first[block, column] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        big.append(left[np.repeat(block, n), at])
        small.append(np.repeat(right[block, column], n))
    return np.concatenate(big), np.concatenate(small)


class Slopes:
    """Pairs of points with different x; ``total`` is how many there are."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        self.x, self.y, self.n = x[order].astype(np.float64), y[order].astype(np.float64), len(x)
        first_larger = np.searchsorted(self.x, self.x, side="right")
        self.first_larger, self.total = first_larger, int((self.n - first_larger).sum())

    def all(self) -> np.ndarray:
        out = [(self.y[k:] - self.y[i]) / (self.x[k:] - self.x[i]) for i, k in enumerate(self.first_larger.tolist()) if k < self.n]
        return np.sort(np.concatenate(out)) if out else np.zeros(0)

    def order(self, s: float) -> np.ndarray:
        if np.isinf(s):
            return np.arange(self.n) if s < 0 else np.argsort(-self.x, kind="stable")
        return np.argsort(self.y - s * self.x, kind="stable")

    def below(self, s: float) -> int:
        ranks = np.empty(self.n, np.int64)
        ranks[self.order(s)] = np.arange(self.n)
        return inversions(ranks)

    def between(self, low: float, high: float) -> np.ndarray:
        """Slopes of the pairs that are not below ``low`` and are below ``high``, sorted."""
        a, b = self.order(low), self.order(high)
        place = np.empty(self.n, np.int64)
        place[a] = np.arange(self.n)
        big, small = inverted_pairs(np.argsort(place[b]))
        i, j = b[big], b[small]
        i, j = np.minimum(i, j), np.maximum(i, j)
        apart = self.x[i] < self.x[j]
        return np.sort((self.y[j[apart]] - self.y[i[apart]]) / (self.x[j[apart]] - self.x[i[apart]]))

    def sample(self) -> np.ndarray:
        """Values between the slopes of random pairs, so that hardly one is a slope itself."""
        rng = np.random.default_rng(0)
        i, j = rng.integers(0, self.n, (2, SAMPLE))
        i, j = i[self.x[i] != self.x[j]], j[self.x[i] != self.x[j]]
        s = np.sort((self.y[j] - self.y[i]) / (self.x[j] - self.x[i]))
        middle = s[:-1] + (s[1:] - s[:-1]) * 0.4142135
        return middle[(middle > s[:-1]) & (middle < s[1:])]

    def at(self, ranks: list[int]) -> list[float]:
        """The slopes of these ranks, from 0.

        Values close about a wanted rank are sought, by counting, until few pairs lie between them; the slopes of those are
        built and sorted. If more pairs than that have one slope, to the last digits, it is taken from any of them.
        """
        if self.total <= FEW_PAIRS:
            every = self.all()
            return [float(every[r]) for r in ranks]
        most, sample, known = 4 * self.n + FEW_PAIRS, self.sample(), {-np.inf: 0, np.inf: self.total}
        return [self._search(r, most, sample, known) for r in ranks]

    def _search(self, r: int, most: int, sample: np.ndarray, known: dict[float, int]) -> float:
        low, high = max(s for s, c in known.items() if c <= r), min(s for s, c in known.items() if c > r)
        steps = 0
        while known[high] - known[low] > most and steps < 200:
            steps += 1
            inside = sample[np.searchsorted(sample, low, side="right") : np.searchsorted(sample, high)]
            share = (r - known[low] + 0.5) / (known[high] - known[low])
            if len(inside) > 8:  # two quantiles of the sample, about the wanted one
                off = 1.5 * np.sqrt(len(inside) * share * (1 - share)) + 2
                tries = [float(inside[int(np.clip(share * len(inside) + d, 0, len(inside) - 1))]) for d in (-off, off)]
            elif np.isinf(high - low):
                edge = np.ptp(self.y) / np.diff(np.unique(self.x)).min() + 1
                tries = [s for s in (-2 * edge, 2 * edge) if low < s < high] or [low + 2 * abs(low) + 1 if np.isinf(high) else high - 2 * abs(high) - 1]
            elif steps % 3:  # as if slopes were spread evenly
                tries = [low + (high - low) * float(np.clip(share + d, 0.01, 0.99)) for d in (-0.1, 0.1)]
            else:
                tries = [low + (high - low) * 0.5]
            tries = sorted({s for s in tries if low < s < high})
            if not tries or high - low < 1e-13 * max(abs(low), abs(high)):
                break
            for s in tries:
                known[s] = self.below(s)
            low, high = max([low, *(s for s in tries if known[s] <= r)]), min([high, *(s for s in tries if known[s] > r)])
        if known[high] - known[low] > most:
            return self._one_between(low, high)
        found = self.between(low, high)
        return float(found[min(max(r - known[low], 0), len(found) - 1)])

    def _one_between(self, low: float, high: float) -> float:
        """The slope of some pair whose order differs between two values: neighbours in the one order that stand otherwise in the other."""
        a, b = self.order(low), self.order(high)
        place = np.empty(self.n, np.int64)
        place[b] = np.arange(self.n)
        k = np.flatnonzero(np.diff(place[a]) < 0)
        i, j = np.minimum(a[k], a[k + 1]), np.maximum(a[k], a[k + 1])
        return float(np.median((self.y[j] - self.y[i]) / (self.x[j] - self.x[i])))
