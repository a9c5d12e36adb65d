"""Brute-force versions of the operators on pairs and strings."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np


def brute_classes(rows, similarity=0.8, words=5):
    """Class of each identifier by all pairs that share a shingle."""
    sets, by_shingle = {}, defaultdict(set)
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            sets[i] = Counter(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1)))
            for s in sets[i]:
                by_shingle[s].add(i)
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    pairs = {p for v in by_shingle.values() for p in combinations(sorted(v), 2)}
    for a, b in pairs:
        both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
        if both >= similarity * either:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in parent}


def brute_removed(texts, length=200):
    """For each text (bytes), which bytes a repeated string covers."""
    count = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        out.append(gone)
    return out
