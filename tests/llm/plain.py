"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWEST = -(2**63)


def number(doc_id):
    return LOWEST if doc_id is None else doc_id


def keep_lines(rows, min_chars=40, min_docs=5):
    """Kept text of each (id, text), in order."""
    holders = defaultdict(set)

    def key(line):
        return line.strip(SPACE).translate(LOWER)

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(number(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or number(doc) == max(holders[key(x)])]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def similar_groups(rows, width, above, below):
    """Smallest linked id of each (id, text)."""
    sets = [shingle_set(t, width) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if number(rows[i][0]) == number(rows[j][0]) and sets[i] and sets[j]
        or sets[i] and sets[j] and below * len(sets[i] & sets[j]) >= above * len(sets[i] | sets[j])
    ]
    group = components(len(rows), links)
    least = defaultdict(lambda: 2**63)
    for g, (doc, _) in zip(group, rows, strict=True):
        least[g] = min(least[g], number(doc))
    return [least[g] for g in group], sets


def repeats(texts, width=200):
    """(bytes, removed, runs, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                covered[i : i + width] = b"\x01" * width
        runs = len(re.findall(rb"\x01+", bytes(covered)))
        out.append((len(b), sum(covered), runs, sha(bytes(x for x, c in zip(b, covered, strict=True) if not c))))
    return out


def passages(rows, items, width=5):
    """Windows of an item's length whose weighted shingles are 0.8 similar or more, the best and first of each
    document and item: {(id, item): (similarity, start, words)}."""

    def counted(w):
        return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))

    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())

    best = {}
    for doc, text in rows:
        w = split(text)
        for item, item_text in items:
            x = split(item_text)
            if not w or not x:
                continue
            for start in range(max(1, len(w) - len(x) + 1)):
                a, b = counted(w[start : start + len(x)]), counted(x)
                share = sum((a & b).values()) / sum((a | b).values())
                if share >= 0.8 and share > best.get((doc, item), (0,))[0]:
                    best[doc, item] = (share, start, len(x))
    return best
