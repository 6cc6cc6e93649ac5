"""Brute force that several tests share."""

import re
from collections import Counter
from fractions import Fraction

SPACE = "[^\x20\x09-\x0D]+"


def brute_components(rows, k, s):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (i is not None and i == rows[b][0] and x and y) or (x and y and len(x & y) >= Fraction(s) * len(x | y)):
                up[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least.setdefault(top(a), []).extend([i] if i is not None else [])
    return Counter((i, len(sets[a]), (min(least[top(a)]) if least[top(a)] else None) if sets[a] else i) for a, (i, _) in enumerate(rows))
