"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(texts: dict, percent=75):
    """(set size, component) by id."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def repeats(rows, least=50):
    """(words repeated, words removed, ids of first occurrences) by id; rows of (id, text)."""
    first, times = {}, Counter()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            first.setdefault(key, (i, p))
            times[key] += 1
    out = {}
    for i, t in rows:
        w, rep, gone, ids = words(t), set(), set(), set()
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            if times[key] > 1:
                rep |= set(range(p, p + least))
                if first[key] != (i, p):
                    gone |= set(range(p, p + least))
                    ids.add(first[key][0])
        if rep:
            out[i] = (len(rep), len(gone), sorted(x for x in ids if x is not None))
    return out


def leaks(texts: dict, items: list, window=10):
    """(words, hit positions, items) by id."""
    runs = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            runs.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = {}
    for i, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for size in {len(r) for r in runs}:
            for p in range(len(w) - size + 1):
                key = tuple(w[p : p + size])
                if key in runs:
                    hit |= set(range(p, p + size))
                    found |= runs[key]
        out[i] = (len(w), sorted(hit), sorted(x for x in found if x is not None))
    return out


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def base_scores(texts: dict):
    """(held out, tokens, known, training tokens, base score) by id."""
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if fold(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (fold(i, 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}
