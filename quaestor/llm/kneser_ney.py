"""Interpolated Kneser-Ney character models kept in sorted hash arrays.

A model holds, per order, the sorted 64-bit hashes of its n-grams with their
interpolated log-probability, and the sorted hashes of its contexts with the log of
the weight that goes to the next lower order.  Look-ups are binary searches over
whole batches of words.  Words are scored as " word " so that the score of a word
does not depend on its neighbours and can be kept.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PAD = 32  # a space stands at both ends of a word


def _hash(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points; rows of different width differ by construction."""
    h = np.full(len(points), points.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1]):
            h = (h ^ points[:, j].astype(np.uint64)) * _PRIME
            h ^= h >> np.uint64(29)
            h *= _MIX
    return h


def _points(words: list[str]) -> np.ndarray:
    """Words as rows of code points between spaces, zero-filled."""
    longest = max(map(len, words))
    out = np.zeros((len(words), longest + 2), np.uint32)
    out[:, 0] = _PAD
    for i, w in enumerate(words):
        p = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, 1 : len(p) + 1] = p
        out[i, len(p) + 1] = _PAD
    return out


class KneserNey:
    def __init__(self, words: dict[str, int], order: int = ORDER):
        """words: how often each word occurs."""
        self.order = order
        names = sorted(w for w in words if w)
        pts = _points(names) if names else np.zeros((0, 2), np.uint32)
        times = np.array([words[w] for w in names], np.int64)
        grams = [self._counted(pts, times, n) for n in range(1, order + 1)]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        alphabet = max(100, len(grams[0][0]) + 1)
        below_hash, below_p = np.zeros(0, np.uint64), np.zeros(0)
        for n in range(1, order + 1):
            g, c = grams[n - 1]
            own = _hash(g)
            if n < order and len(grams[n][0]):
                # lower orders count the distinct characters that come before; those that only begin words keep one
                tails, many = np.unique(_hash(grams[n][0][:, 1:]), return_counts=True)
                at = np.minimum(np.searchsorted(tails, own), len(tails) - 1)
                c = np.where(tails[at] == own, many[at], 1)
            one, two = int((c == 1).sum()), int((c == 2).sum())
            discount = min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5
            heads, back = np.unique(_hash(g[:, :-1]), return_inverse=True)
            total = np.bincount(back, weights=c, minlength=len(heads)).clip(1)
            weight = discount * np.bincount(back, minlength=len(heads)) / total
            if n == 1:
                below = np.full(len(g), 1.0 / alphabet)
            else:
                below = below_p[np.minimum(np.searchsorted(below_hash, _hash(g[:, 1:])), len(below_p) - 1)]
            p = (c - discount).clip(0) / total[back] + weight[back] * below
            rank = np.argsort(own)
            below_hash, below_p = own[rank], p[rank]
            self.grams.append((below_hash, np.log(below_p).astype(np.float32)))
            self.weights.append((heads, np.log(weight.clip(1e-9)).astype(np.float32)))
        first = self.weights[0][1]
        self.unseen = (float(first[0]) if len(first) else 0.0) - float(np.log(alphabet))

    @staticmethod
    def _counted(pts: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the words, and how often each occurs."""
        ends = [e for e in range(max(1, n - 1), pts.shape[1])]
        rows = [pts[pts[:, e] > 0, e - n + 1 : e + 1] for e in ends]
        if not rows:
            return np.zeros((0, n), np.uint32), np.zeros(0, np.int64)
        count = np.concatenate([times[pts[:, e] > 0] for e in ends])
        rows = np.concatenate(rows)
        _, first, back = np.unique(_hash(rows), return_index=True, return_inverse=True)
        return rows[first], np.bincount(back, weights=count).astype(np.int64)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return hit, np.where(hit, values[at], np.float32(0))

    def score(self, pts: np.ndarray) -> np.ndarray:
        """Log-probability of each row made by `_points`, the closing space included."""
        out = np.zeros(len(pts), np.float32)
        for end in range(1, pts.shape[1]):
            rows = np.flatnonzero(pts[:, end] > 0)
            if not len(rows):
                break
            got = np.zeros(len(rows), np.float32)
            open_ = np.ones(len(rows), bool)
            for n in range(min(self.order, end + 1), 0, -1):
                piece = pts[rows, end - n + 1 : end + 1]
                hit, lp = self._find(self.grams[n - 1], _hash(piece))
                now = open_ & hit
                got[now] += lp[now]
                open_ &= ~hit
                if not open_.any():
                    break
                if n > 1:
                    seen, lw = self._find(self.weights[n - 1], _hash(piece[:, :-1]))
                    got[open_ & seen] += lw[open_ & seen]
            got[open_] += self.unseen
            out[rows] += got
        return out
