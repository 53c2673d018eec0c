"""Brute-force forms of the contracts."""

import re


def word_sets(rows, size):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def near_components(rows, size, threshold):
    """{doc: (set size, smallest reachable doc)}, every pair compared that shares a shingle."""
    sets = word_sets(rows, size)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    seen = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def bench_tokens(text):
    import string
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").translate({ord(c): None for c in string.punctuation})
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def overlaps(doc, item, window=13, threshold=80):
    """Most equal tokens of a window, over all diagonals; None when under the threshold."""
    if min(len(doc), len(item)) < 8:
        return None
    w, best = min(window, len(item)), 0
    common = set(item)
    places = [i for i, x in enumerate(doc) if x in common]
    for diag in {p - q for p in places for q, y in enumerate(item) if doc[p] == y}:
        same = [0 <= q + diag < len(doc) and doc[q + diag] == y for q, y in enumerate(item)]
        best = max(best, *(sum(same[s:s + w]) for s in range(len(item) - w + 1)))
    return best if 100 * best >= threshold * w else None
