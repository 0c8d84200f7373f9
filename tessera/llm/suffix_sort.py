"""Blockwise suffix sorting with a difference cover.

A difference cover D of v meets every difference: for any i, j some d < v has both i + d and j + d in D modulo v.  The
suffixes at sample positions (those in D modulo v) are ranked once, by prefix doubling.  Any bucket of suffixes is then
sorted by their first v bytes, and suffixes that tie by the ranks d further on, so that the time for a bucket doesn't
depend on how long its repeats are, and its memory only on its size.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np

#: Positions modulo 32 whose differences are all of 0..31.
PERIOD = 32
COVER = (0, 1, 2, 3, 7, 11, 19)


def covers(cover: tuple[int, ...], v: int) -> bool:
    return len({(a - b) % v for a in cover for b in cover}) == v


def words_at(text: np.ndarray, positions: np.ndarray, n_bytes: int) -> np.ndarray:
    """The bytes from each position as big-endian words, a row each; zeros follow the text."""
    n = -(-n_bytes // 8) * 8
    padded = np.concatenate([text, np.zeros(n + 1, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, n)[positions]
    if n > n_bytes:
        rows = rows.copy()
        rows[:, n_bytes:] = 0
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def dense_ranks(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows given by their columns, and each row's rank; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return order, ranks


class SuffixSorter:
    def __init__(self, text: np.ndarray, cover: tuple[int, ...] = COVER, v: int = PERIOD) -> None:
        if not covers(cover, v):
            raise ValueError("not a difference cover")
        self.text, self.v = text, v
        n = len(text)
        member = np.zeros(v, bool)
        member[list(cover)] = True
        self.to_sample = np.array([next(d for d in range(v) if member[(r + d) % v]) for r in range(v)])
        self.both = [[next(d for d in range(v) if member[(a + d) % v] and member[(b + d) % v]) for b in range(v)] for a in range(v)]
        at = np.arange(n)
        sample = at[member[at % v]]
        rank = np.full(n + v + 1, -1, np.int64)
        if len(sample):
            w = words_at(text, sample, v)
            # What ends early comes before what goes on with zeros.
            _, r = dense_ranks([*(w[:, k] for k in range(w.shape[1])), np.minimum(n - sample, v)])
            rank[sample] = r
            step = v
            while r.max() + 1 < len(sample) and step < n:
                ahead = sample + step
                after = np.where(ahead < n, rank[np.minimum(ahead, n)], -1)
                _, r = dense_ranks([r, after])
                rank[sample] = r
                step *= 2
        self.rank = rank

    def sort(self, positions: np.ndarray) -> np.ndarray:
        """The positions of one bucket in the order of their suffixes."""
        positions = np.asarray(positions, np.int64)
        if not len(positions):
            return positions
        v, n = self.v, len(self.text)
        w = words_at(self.text, positions, v)
        columns = [*(w[:, k] for k in range(w.shape[1])), np.minimum(n - positions, v)]
        _, tie = dense_ranks(columns)
        residue = positions % v
        ahead = np.minimum(positions + self.to_sample[residue], n + v)
        order = np.lexsort((self.rank[ahead], residue, tie))
        p, t, r = positions[order], tie[order], residue[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        mixed = np.add.reduceat((np.concatenate([[False], (t[1:] == t[:-1]) & (r[1:] != r[:-1])])).astype(np.int64), starts) > 0
        for s in np.flatnonzero(mixed):
            a = starts[s]
            b = starts[s + 1] if s + 1 < len(starts) else len(p)
            p[a:b] = sorted(p[a:b].tolist(), key=cmp_to_key(self.compare))
        return p

    def compare(self, i: int, j: int) -> int:
        """Of suffixes with the same first v bytes."""
        d = self.both[i % self.v][j % self.v]
        n = len(self.text)
        a = self.rank[i + d] if i + d < n else -1
        b = self.rank[j + d] if j + d < n else -1
        if a == b == -1:
            return (i < j) - (i > j)
        return int(a > b) - int(a < b)
