"""Suffix arrays by linear grouping.

The first phase sorts suffixes by their Lyndon prefix (their longest prefix that is a Lyndon word). It starts from groups of equal first
symbols and takes the groups in descending order. Each suffix of the group at hand points to the next suffix on its left that is in a
smaller group, which is one not taken yet; the suffixes that are pointed to, by most pointers first, move to a new
group right above their old one, as the group's prefix now follows theirs. The second phase takes the suffix array in ascending order: the
suffix before the one at hand, and those along its pointers, are the next of their groups. No part is renamed or sorted again.

The pointers are kept for both phases. Of a group's members, which are held in ascending order, each leads on from the pointer of the
member before it, so all pointers together take linear time.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes in order. Symbols are whole numbers of 0 or more; a shorter suffix comes before a longer one that
    it begins."""
    text = [*symbols, -1]
    n = len(text)
    members: list[list[int]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        for i in by_symbol[c]:
            group[i] = g
    # neighbours in the order of groups
    below, above = [g - 1 for g in range(len(members))], [g + 1 for g in range(len(members))]
    size = [len(m) for m in members]
    above[-1] = -1
    left = list(range(-1, n - 1))
    taken = bytearray(n + 1)
    taken_groups: list[int] = []
    at = len(members) - 1
    while at >= 0:
        taken_groups.append(at)
        own = members[at]
        if len(own) != size[at]:
            own = members[at] = [i for i in own if group[i] == at]
        for i in own:
            taken[i] = 1
        # runs of equal pointers: pointers ascend with the members
        pointed: list[int] = []
        times: list[int] = []
        last = -1
        for i in own:
            p = left[i]
            while p >= 0 and taken[p]:
                p = left[p]
            left[i] = p
            if p >= 0:
                if p == last:
                    times[-1] += 1
                else:
                    pointed.append(p)
                    times.append(1)
                    last = p
        if len(pointed) == 1:
            parts = [pointed] if size[group[pointed[0]]] > 1 else []
        else:
            by_times: dict[int, list[int]] = {}
            for p, k in zip(pointed, times):
                if size[group[p]] > 1:
                    by_times.setdefault(k, []).append(p)
            parts = [by_times[k] for k in sorted(by_times, reverse=True)]
        for part in parts:
            moved: dict[int, list[int]] = {}
            for p in part:
                moved.setdefault(group[p], []).append(p)
            for old, some in moved.items():
                if len(some) == size[old]:
                    continue
                new = len(members)
                members.append(some)
                size.append(len(some))
                size[old] -= len(some)
                for p in some:
                    group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        at = below[at]
    place = [0] * len(members)
    start = 0
    for g in reversed(taken_groups):
        place[g] = start
        start += size[g]
    order = [0] * n
    order[0] = n - 1
    group[n - 1] = -1
    for k in range(n):
        j = order[k] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            order[place[g]] = j
            place[g] += 1
            group[j] = -1
            j = left[j]
    return order[1:]
