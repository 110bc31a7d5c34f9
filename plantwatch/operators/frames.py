"""Order statistics of many frames of one list, all frames at once.

A merge tree over the list's ranks: each level deals the ranks by one more bit,
zeros before ones, and keeps the running count of zeros. A rank's frame at the
next level is two look-ups in that count, so the k-th value of a frame, or how
many of its values lie below another, takes one step a bit for all frames
together. The list is kept once, whatever the frames' lengths and overlaps.
"""

from __future__ import annotations

import numpy as np


class Frames:
    """Frames [low, high) of `values`, none of them NaN; arguments are arrays of one length, one entry a frame."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, ranks = np.unique(np.asarray(values, float), return_inverse=True)
        self.bits = max(1, int(max(0, len(self.values) - 1)).bit_length())
        self.zeros = []
        for b in reversed(range(self.bits)):
            ones = (ranks >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value of each frame, k from 0 and below the frame's length."""
        low, high, k = (np.array(a, np.int64) for a in (low, high, k))
        rank = np.zeros(len(k), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, z = zeros[low], zeros[high]
            up = k >= z - a
            k = np.where(up, k - (z - a), k)
            low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - z, z)
            rank |= up.astype(np.int64) << b
        return self.values[rank] if len(self.values) else np.full(len(k), np.nan)

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values of each frame are less than x, or with side "right" at most x."""
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        rank = np.searchsorted(self.values, x, side)
        all_ = rank >= 1 << self.bits
        count = np.where(all_, high - low, 0)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, z = zeros[low], zeros[high]
            up = (rank >> b & 1).astype(bool)
            count += np.where(up & ~all_, z - a, 0)
            low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - z, z)
        return count

    def quantile(self, low: np.ndarray, high: np.ndarray, share: float) -> np.ndarray:
        """The `share` quantile of each frame, linear between ranks; NaN for an empty one."""
        low, high = np.asarray(low), np.asarray(high)
        out, some = np.full(len(low), np.nan), high > low
        place = (high - low - 1)[some] * share
        k = np.floor(place).astype(np.int64)
        a = self.nth(low[some], high[some], k)
        b = self.nth(low[some], high[some], np.minimum(k + 1, (high - low - 1)[some]))
        with np.errstate(invalid="ignore"):
            out[some] = np.where((k == place) | (a == b), a, a + (b - a) * (place - k))
        return out

    def _nth_distance(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least |value - centre| of each frame: values on either side rise outwards, so how many come from below is bisected."""
        left = self.below(low, high, centre)
        right = high - low - left
        down = lambda i: centre - self.nth(low, high, np.clip(left - 1 - i, 0, high - low - 1))
        up = lambda j: self.nth(low, high, np.clip(left + j, 0, high - low - 1)) - centre
        a, b = np.maximum(0, k + 1 - right), np.minimum(k + 1, left)
        while (open_ := a < b).any():
            i = (a + b) // 2
            more = open_ & (i < left) & (k - i >= 0) & (down(i) < up(k - i))  # the next from below is nearer than the last from above
            a, b = np.where(more, i + 1, a), np.where(open_ & ~more, i, b)
        j = k + 1 - a
        return np.maximum(np.where(a > 0, down(a - 1), -np.inf), np.where(j > 0, up(j - 1), -np.inf))

    def median_distance(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The median of |value - centre| of each frame; NaN for an empty one."""
        low, high, centre = np.asarray(low), np.asarray(high), np.asarray(centre, float)
        out, some = np.full(len(low), np.nan), high > low
        low, high, centre = low[some], high[some], centre[some]
        n = high - low
        out[some] = (self._nth_distance(low, high, centre, (n - 1) // 2) + self._nth_distance(low, high, centre, n // 2)) / 2
        return out


class Sums:
    """Sums of frames [low, high) of `values`, each put together from a tree of pairwise sums.

    Nothing is subtracted, so what lies outside a frame can't touch its sum; a
    frame takes two look-ups a level.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [np.asarray(values, float)]
        with np.errstate(invalid="ignore", over="ignore"):
            while len(self.levels[-1]) > 1:
                level = self.levels[-1]
                level = np.append(level, 0.0) if len(level) % 2 else level
                self.levels.append(level[0::2] + level[1::2])

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        total = np.zeros(len(low))
        with np.errstate(invalid="ignore", over="ignore"):
            for level in self.levels:
                odd = (low < high) & (low % 2 == 1)
                total[odd] += level[low[odd]]
                low[odd] += 1
                odd = (low < high) & (high % 2 == 1)
                high[odd] -= 1
                total[odd] += level[high[odd]]
                low, high = low >> 1, high >> 1
        return total
