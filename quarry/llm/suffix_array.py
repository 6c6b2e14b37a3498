"""Difference-cover (mod 3) suffix sorting in numpy, and classes of equal prefixes."""

from __future__ import annotations

import numpy as np


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows compared by keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1) in ascending order.

    Suffixes at places 1 and 2 mod 3 are named by their triples, and sorted by
    recursion on the names if names repeat; those at 0 mod 3 sort by their first
    symbol and the rank of what follows, and the two lists merge.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = _dense(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    sa12 = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    zeros = np.arange(0, n, 3)
    big = np.int64(len(sample) + 2)
    first = t[:n] * big + rank[1 : n + 1]
    sa0 = zeros[np.argsort(first[zeros], kind="stable")]
    one, two = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    before = np.searchsorted(first[one], first[sa0])
    pair = _dense(t[:n], t[1 : n + 1])
    second = pair * big + rank[2 : n + 2]
    before = before + np.searchsorted(second[two], second[sa0])
    out = np.full(n, -1, np.int64)
    out[before + np.arange(len(sa0))] = sa0
    out[out < 0] = sa12
    return out


def prefix_classes(s: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """A class for each place of s: equal where adjacent suffixes share their first ``length`` symbols."""
    t = np.concatenate([s, np.zeros(length, s.dtype)])
    same = np.zeros(len(sa), bool)
    left = np.arange(1, len(sa))
    for i in range(length):
        left = left[t[sa[left] + i] == t[sa[left - 1] + i]]
    same[left] = True
    out = np.empty(len(sa), np.int64)
    out[sa] = np.cumsum(~same)
    return out
