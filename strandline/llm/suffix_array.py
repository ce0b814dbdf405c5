"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix, the longest Lyndon word that they begin with. First they are
grouped by their first symbol. Groups are then processed in descending order: each member points to the
previous smaller suffix, and the suffixes so pointed at, whose Lyndon prefix goes on with that of the
group, leave their group for a new one right above it, those pointed at more often further above. Once all
groups are final, suffixes in ascending order put those before them that no smaller suffix parts from them
at the front of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in ascending order. s is made of integers and ends in its unique least one."""
    n = len(s)
    if n < 2:
        return list(range(n))
    by = defaultdict(list)
    for i, c in enumerate(s):
        by[c].append(i)
    sa: list[int] = []
    start, end = [0] * n, {}  # of the group of each suffix; end of the group that starts at a place
    for c in sorted(by):
        a = len(sa)
        sa += by[c]
        end[a] = len(sa)
        for i in by[c]:
            start[i] = a
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    prev = [-1] * n
    hi = n
    while hi > 0:
        g = start[sa[hi - 1]]
        members = sorted(sa[g:hi])
        times: Counter = Counter()
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= g:  # groups at or above g know their previous smaller suffix
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] += 1
        levels = defaultdict(list)
        for j, k in times.items():
            levels[k].append(j)
        for k in sorted(levels, reverse=True):
            tails = {}
            for j in levels[k]:  # swap to the end of its group
                a = start[j]
                e = tails.get(a, end[a]) - 1
                tails[a] = e
                x, p = sa[e], place[j]
                sa[e], sa[p] = j, x
                place[j], place[x] = e, p
            for a, e in tails.items():
                if e == a:
                    continue  # the whole group moves on as it is
                top = end[a]
                end[a], end[e] = e, top
                for q in range(e, top):
                    start[sa[q]] = e
        hi = g
    front = dict.fromkeys(end)
    for a in end:
        front[a] = a
    out = [0] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    front[start[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            a = start[j]
            out[front[a]] = j
            front[a] += 1
            done[j] = True
            j = prev[j]
    return out


def lcp_array(s: list[int], sa: list[int]) -> list[int]:
    """Length of the longest common prefix of each suffix and the one before it in order."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    lcp, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return lcp
