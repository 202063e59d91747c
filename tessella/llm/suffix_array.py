"""Suffix arrays by linear grouping construction.

Phase 1 groups suffixes by their longest Lyndon prefix. Groups are taken in descending order; for the members of a
group the previous smaller suffix (the nearest one before it in a lower group) is found by chasing pointers, and the
suffixes so found move up: those that precede l members in a row form a new group above those that precede fewer, as
their prefix grows by l copies. Phase 2 emits each group's order: in ascending order of suffixes, the suffix before the
current one and its chain of previous smaller suffixes take the next free place of their groups, until one is placed
already. No names are assigned and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of positive integers; the end is smaller than any of them."""
    s = np.concatenate((np.asarray(text, dtype=np.int64), [0]))
    n = len(s)
    order = np.argsort(s, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(s[order]) != 0)))
    sizes = np.diff(np.append(starts, n))
    link = np.empty(n, dtype=np.int64)
    link[order] = np.repeat(starts, sizes)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    size = [0] * n
    for at, k in zip(starts.tolist(), sizes.tolist(), strict=True):
        size[at] = k
    # Plain lists: single items are read and written far more often than whole arrays.
    sa, isa, group = order.tolist(), place.tolist(), link.tolist()
    prev = list(range(-1, n - 1))
    _group_by_lyndon_prefix(sa, isa, group, size, prev)
    return _order_within_groups(group, prev, n)[1:]


def _group_by_lyndon_prefix(sa: list[int], isa: list[int], group: list[int], size: list[int], prev: list[int]) -> None:
    top = len(sa) - 1
    while top > 0:
        low = group[sa[top]]
        if low == top:  # one member: the suffix before it moves up alone
            i = sa[top]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                k = size[g] - 1
                if k:
                    end = g + k
                    other, at = sa[end], isa[p]
                    sa[at], isa[other] = other, at
                    sa[end], isa[p] = p, end
                    size[g], size[end] = k, 1
                    group[p] = end
        else:
            followed: dict[int, int] = {}
            for i in sa[low : top + 1]:
                p = i - 1
                while p >= 0 and group[p] >= low:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    followed[p] = followed.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, k in followed.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                moved = by_count[k]
                for p in moved:
                    g = group[p]
                    rest = size[g] - 1
                    end = g + rest
                    other, at = sa[end], isa[p]
                    sa[at], isa[other] = other, at
                    sa[end], isa[p] = p, end
                    size[g] = rest
                fresh = [group[p] + size[group[p]] for p in moved]
                for g in fresh:
                    size[g] = 0
                for p, g in zip(moved, fresh, strict=True):
                    group[p] = g
                    size[g] += 1
        top = low - 1


def _order_within_groups(group: list[int], prev: list[int], n: int) -> np.ndarray:
    out = [0] * n
    out[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    free = list(range(n))  # next place of the group that starts there
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            j = prev[j]
    return np.array(out, dtype=np.int64)
