"""Patience alignment of two sequences of hashes, shared by line dedup and license scans."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, sorted by the first, whose second members rise."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        if i == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[i] = b
            at[i] = k
        before[k] = at[i - 1] if i else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list, repeats: bool = False) -> list[tuple[int, int]]:
    """Matching positions (i, j), rising in both: equal ends are matched, entries that occur once on either side
    anchor, and the gaps between anchors are aligned in turn. With ``repeats``, a gap that has no such entry is
    anchored by the rarest one that occurs equally often on either side, occurrence by occurrence."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        once = {x for x, c in ca.items() if c == 1 and cb.get(x) == 1}
        same = [x for x, c in ca.items() if cb.get(x) == c] if repeats and not once else []
        if once:
            where = {b[k]: k for k in range(j, n) if b[k] in once}
            anchors = _rising([(k, where[a[k]]) for k in range(i, m) if a[k] in once])
        elif same:
            rare = min(same, key=ca.get)
            anchors = list(zip((k for k in range(i, m) if a[k] == rare), (k for k in range(j, n) if b[k] == rare)))
        else:
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if u > x + 1 and v > y + 1]
    return sorted(out)
