"""Suffix arrays by linear grouping: groups of Lyndon prefixes, then each group's order, without renaming or recursion."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """The suffixes of a sequence of numbers in lexicographic order, in linear time.

    First, groups of suffixes, begun by first symbol, are taken from the highest to the lowest. For each suffix of a group
    a pointer goes to the nearest one before it in a lower group. Suffixes that are pointed at move to new groups right
    above their old ones, those with more pointers higher; so each group gets the suffixes with one Lyndon prefix. Then
    the order is emitted from the lowest suffix on: the one before a placed suffix, and those that its pointers lead to,
    take the next places of their groups."""
    n = len(text)
    if n == 0:
        return []
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    first = np.flatnonzero(new)
    begin = first[np.cumsum(new) - 1]
    group_of = np.empty(n, np.int64)
    group_of[order] = begin
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size_of = np.zeros(n, np.int64)
    size_of[first] = np.diff(first, append=n)
    # plain lists are faster to index one by one
    sa, at, group, size, prev = order.tolist(), place.tolist(), group_of.tolist(), size_of.tolist(), [-1] * n
    end = n
    while end > 0:
        low = group[sa[end - 1]]
        if end - low == 1:
            s = sa[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:  # one pointer: it moves to the top of its group
                g = group[p]
                m = size[g]
                if m > 1:
                    to = g + m - 1
                    i, other = at[p], sa[to]
                    sa[i], sa[to], at[other], at[p] = other, p, i, to
                    size[g], size[to], group[p] = m - 1, 1, to
            end = low
            continue
        counts: dict[int, int] = {}
        for s in sorted(sa[low:end]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        end = low
        if not counts:
            continue
        levels: dict[int, list[int]] = {}
        for p, c in counts.items():
            levels.setdefault(c, []).append(p)
        for c in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[c]:  # to the end of their groups
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                to = g + size[g] - k
                i = at[p]
                if i != to:
                    other = sa[to]
                    sa[i], sa[to], at[other], at[p] = other, p, i, to
            for g, k in moved.items():
                m = size[g]
                if k < m:
                    start = g + m - k
                    size[g], size[start] = m - k, k
                    for p in sa[start : g + m]:
                        group[p] = start
    out = [-1] * n
    free = list(range(n))  # the next place of each group, by its first
    placed = bytearray(n)

    def put(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]

    put(n - 1)  # the shortest suffix comes first in its group
    for i in range(n):
        put(out[i] - 1)
    return out

