"""Suffix sorting by linear grouping.

Every suffix begins with a longest Lyndon word, which ends where the next smaller suffix begins. ``suffix_order`` groups
suffixes by that word: groups are processed from the largest down, each suffix hands its word to the nearest earlier
suffix of a smaller group (its previous-smaller pointer), and the receivers are split off their groups by how often they
received it. When all groups are done they are in order, and one pass emits the suffixes: a suffix takes the next place
in its group when the suffix after its word is emitted. Nothing is renamed and sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order. The last symbol has to be smaller than all others."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    group, size, order = _groups(symbols)
    return _emit(group, size, order)


def _groups(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each suffix's group, the length of its Lyndon prefix, and the groups in ascending order."""
    n = len(symbols)
    values, first = np.unique(symbols, return_inverse=True)
    group = first.tolist()
    by = np.argsort(first, kind="stable")
    cut = np.searchsorted(first[by], np.arange(len(values) + 1))
    members: list[list[int]] = [by[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    below = list(range(-1, len(values) - 1))
    above = [*range(1, len(values)), -1]
    size, word = [1] * n, [1] * len(values)
    before = list(range(-1, n - 1))
    done = [False] * n
    now = len(values) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            done[i] = True
        got: dict[int, int] = {}
        for i in own:
            p = before[i]
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                got[p] = got.get(p, 0) + 1
        if got:
            length = word[now]
            split: dict[tuple[int, int], list[int]] = {}
            for p, times in got.items():
                split.setdefault((times, group[p]), []).append(p)
                size[p] += times * length
            # The more often the word follows, the larger: those are put next to their old group first.
            for times, old in sorted(split, reverse=True) if len(split) > 1 else split:
                moved = split[times, old]
                new = len(members)
                members.append(moved)
                word.append(size[moved[0]])
                for p in moved:
                    group[p] = new
                up = above[old]
                above[old] = new
                below.append(old)
                above.append(up)
                if up >= 0:
                    below[up] = new
        now = below[now]
    order, now = [], 0
    while now >= 0:
        order.append(now)
        now = above[now]
    return group, size, order


def _emit(group: list[int], size: list[int], order: list[int]) -> np.ndarray:
    n = len(group)
    g, length = np.array(group), np.array(size)
    place = np.full(int(g.max()) + 1, -1)
    place[order] = np.arange(len(order))
    rank = place[g]
    start = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(order)))])
    after = np.arange(n) + length
    by = np.argsort(after, kind="stable")
    cut = np.searchsorted(after[by], np.arange(n + 1)).tolist()
    waiting, rank_of, free = by.tolist(), rank.tolist(), start.tolist()
    out = [-1] * n
    out[0] = n - 1
    free[rank_of[n - 1]] += 1
    for k in range(n):
        i = out[k]
        for j in waiting[cut[i] : cut[i + 1]]:
            r = rank_of[j]
            out[free[r]] = j
            free[r] += 1
    return np.array(out)
