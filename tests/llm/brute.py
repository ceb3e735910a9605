"""Plain Python versions of the rules, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def union(ids, links):
    """The smallest id that links reach, for each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def shingle_set(text: str | None, k: int = 4) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    links = []
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    return union(texts, links)


def deduplicated(texts: dict[int, str | None], min_words: int = 50) -> dict[int, str | None]:
    """Texts by id without the lines of maximal runs, of enough words, that have an earlier copy."""
    lines = [
        (i, n, x, len(re.findall(r"\S+", x)))
        for i in sorted(texts)
        for n, x in enumerate((texts[i] or "").split("\n"))
        if re.search(r"\S", x)
    ]
    places, cut = defaultdict(list), set()

    def alike(p, q):
        return p >= 0 <= q and lines[p][2] == lines[q][2]

    def together(p, q):
        return q < len(lines) and p < len(lines) and lines[p][0] == lines[p - 1][0] and lines[q][0] == lines[q - 1][0]

    for p, (_, _, x, _) in enumerate(lines):
        for q in places[x]:
            if together(p, q) and alike(p - 1, q - 1):
                continue  # inside a run that was followed from its start
            stop, words = 0, 0
            while p + stop < len(lines) and alike(p + stop, q + stop) and (not stop or together(p + stop, q + stop)):
                words += lines[p + stop][3]
                stop += 1
            if words >= min_words:
                cut.update(row[:2] for row in lines[p : p + stop])
        places[x].append(p)
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in cut)
        for i, t in texts.items()
    }


def overlapping(texts: dict[int, str | None], items: dict[int, str], window: int = 16, percent: int = 80) -> set:
    """(id, item) pairs with a window that agrees in enough words along one alignment."""

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    found = set()
    for i, text in texts.items():
        w = words(text)
        for item, other in items.items():
            x = words(other)
            size = min(window, len(x))
            for shift in range(-len(x) + 1, len(w)):
                same = [w[shift + t] == x[t] for t in range(max(0, -shift), min(len(x), len(w) - shift))]
                if any(100 * sum(same[a : a + size]) >= percent * size for a in range(len(same) - size + 1)):
                    found.add((i, item))
                    break
    return found
