"""Brute-force counterparts of the training-data operators."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def word_shingles(text, k):
    w = space_words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def char_shingles(line, q):
    return {line[i:i + q] for i in range(max(1, len(line) - q + 1))}


def components(nodes, links):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_pairs(sets, num=80, den=100):
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and len(x) * den >= len(y) * num and len(y) * den >= len(x) * num:
                inter = len(x & y)
                if den * inter >= num * (len(x) + len(y) - inter):
                    yield a, b
