"""Plain-Python versions of the operators' definitions."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def exact(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d))
    out = {}
    for plain, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            out[d] = (keep, len(members), d == keep, hashlib.sha256(plain.encode()).hexdigest())
    return out


def components(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, size=13):
    split = {d: words(t, lower=False) for d, t in docs}
    first = {}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def contained(docs, items, percent=80):
    out = {}
    sets = {i: shingles(t) for i, t in items}
    for d, t in docs:
        own = shingles(t)
        for i, s in sets.items():
            if s and 100 * len(own & s) >= percent * len(s):
                out[d, i] = (len(s), len(own & s))
    return out


def base_scores(docs, held):
    import math
    train = Counter()
    for d, t in docs:
        if not held(d):
            train.update(words(t))
            train[b"</end>"] += 1
    total, distinct = sum(train.values()), len(train)
    out = {}
    for d, t in docs:
        tokens = words(t) + [b"</end>"]
        out[d] = (len(tokens), sum(train[w] > 0 for w in tokens), total,
                  sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens))
    return out
