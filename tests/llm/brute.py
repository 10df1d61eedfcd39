"""Plain versions of the operators' results, for small tables."""
from __future__ import annotations

import re
from collections import defaultdict


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(words, k):
    return frozenset(tuple(words[i: i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(text))


def components(docs, k, percent):
    """{doc_id: (set size, smallest reachable id)} of {doc_id: text}."""
    sets = {i: shingles(blank_words(t), k) for i, t in docs.items()}
    holders, parent = defaultdict(list), {i: i for i in docs}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in docs}


def contained(docs, items, k, percent):
    """{(doc_id, item_id, hits)} over distinct items."""
    distinct = {}
    for i, t in sorted(items.items()):
        s = shingles(plain_words(t), k)
        if s:
            distinct.setdefault(s, i)
    out = set()
    for d, t in docs.items():
        have = shingles(plain_words(t), k)
        for s, i in distinct.items():
            n = len(s & have)
            if n and 100 * n >= percent * len(s):
                out.add((d, i, n))
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)
