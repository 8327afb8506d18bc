"""Brute force for tests."""

from collections import defaultdict


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs: dict) -> dict:
    """Of each document the smallest id reachable by links; pairs that share a shingle are compared."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for k in {k for x in s for k in by[x] if k < i}:
            n = len(s & sets[k])
            if 100 * n >= 80 * (len(s) + len(sets[k]) - n):
                a, b = sorted((root(i), root(k)))
                label[b] = a
    return {i: root(i) for i in docs}
