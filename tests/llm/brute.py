"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_components(rows, k, percent):
    """{(id, text): smallest id reachable} over all pairs."""
    sets = {(i, t): shingle_set(t, k) for i, t in rows}
    up = {key: key for key in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [key for key in sets if sets[key] and key[0] is not None]
    for a, b in combinations(live, 2):
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            up[root(a)] = root(b)
    least = {}
    for key in live:
        r = root(key)
        least[r] = min(least.get(r, key[0]), key[0])
    return {key: least[root(key)] if key in live else key[0] for key in sets}


def tiled(item, doc, least):
    """Greedy string tiling by trying every pair of places."""
    least = min(least, len(item))
    free_item, free_doc, covered = [True] * len(item), [True] * len(doc), 0
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (
                    i + n < len(item)
                    and j + n < len(doc)
                    and free_item[i + n]
                    and free_doc[j + n]
                    and item[i + n] == doc[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        free_item[i : i + n] = [False] * n
        free_doc[j : j + n] = [False] * n
        covered += n
    return covered


def targets(sizes, weights, repeats=3):
    """Cap, reshare, and again until nothing is above its cap."""
    out = [None] * len(sizes)
    while True:
        left = sum(sizes) - sum(x for x in out if x is not None)
        open_ = [i for i, x in enumerate(out) if x is None]
        total = sum(weights[i] for i in open_)
        shares = {i: left * weights[i] / total for i in open_}
        above = [i for i in open_ if shares[i] > repeats * sizes[i]]
        if not above:
            return [shares[i] if x is None else x for i, x in enumerate(out)]
        for i in above:
            out[i] = repeats * sizes[i]


def multiset(rows):
    return Counter(tuple(r) for r in rows)
