"""Plain Python versions of the text operators."""

import re
from collections import defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(docs, n, percent=80):
    """doc_id -> (smallest id reachable, size of the shingle set), by comparing all pairs."""
    sets = {}
    for d, text in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for other in holders[s]:
                shared[other] += 1
            holders[s].append(d)
        for other, k in shared.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[other]) - k):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
    return {d: (find(d), len(sets[d])) for d in docs}


def kept_words(docs, n):
    """doc_id -> words left when windows that start in a smaller doc_id go."""
    first = {}
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i:i + n]), d)
    out = {}
    for d, text in docs.items():
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out
