"""Suffix sorting by grouping, in linear time and without recursive renaming."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol is smaller than all others.

    First the suffixes are put in groups of one Lyndon prefix each: groups are taken from the largest down;
    each suffix in the group points to the nearest one before it that lies in a smaller group, and suffixes
    pointed at move to new groups right above their own, the higher the more of the group point at them. Then
    the smallest suffix is known, and each suffix in order fixes the place, at the front of what is left of
    its group, of the one before it and of those that this one's pointers lead to.
    """
    n = len(text)
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        by_symbol[c].append(i)
    members: list[set[int]] = []
    below: list[int] = []  # groups are a chain; new ones never stand above the one at hand
    above: list[int] = []
    rank = {c: k for k, c in enumerate(sorted(by_symbol))}
    for c in sorted(by_symbol):
        members.append(set(by_symbol[c]))
        below.append(len(members) - 2)
        above.append(len(members))
    group = [rank[c] for c in text]
    done = bytearray(n)
    pointer = [-1] * n
    at = above[-1] = len(members) - 1
    order = []
    while at >= 0:
        order.append(at)
        here = sorted(members[at])
        for s in here:
            done[s] = 1
        found = []
        for s in here:
            p = s - 1
            while p >= 0 and done[p]:
                p = pointer[p]
            pointer[s] = p
            if p >= 0:
                found.append(p)
        by_count: dict[int, list[int]] = {}
        if len(set(found)) == len(found):
            by_count[1] = found
        else:
            for p, k in Counter(found).items():
                by_count.setdefault(k, []).append(p)
        # new groups stand right above their own, made from the lowest count up
        top: dict[int, int] = {}
        for k in sorted(by_count):
            leaving: dict[int, list[int]] = {}
            for p in by_count[k]:
                g = group[p]
                if g in leaving:
                    leaving[g].append(p)
                else:
                    leaving[g] = [p]
            for g, moved in leaving.items():
                last = top.get(g, g)
                if last == g and len(moved) == len(members[g]):
                    continue  # the whole group: it stays
                new = top[g] = len(members)
                members[g].difference_update(moved)
                members.append(set(moved))
                below.append(last)
                above.append(above[last])
                below[above[last]] = new
                above[last] = new
                for p in moved:
                    group[p] = new
        at = below[at]
    return _emit(n, members, order, group, pointer)


def _emit(n: int, members: list[set[int]], order: list[int], group: list[int], pointer: list[int]) -> list[int]:
    front = [0] * len(members)
    total = 0
    for g in reversed(order):
        front[g] = total
        total += len(members[g])
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    front[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            out[front[group[s]]] = s
            front[group[s]] += 1
            placed[s] = 1
            s = pointer[s]
    return out
