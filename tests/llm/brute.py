"""Plain Python versions of the corpus queries' contracts, row by row."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def secret_base(text):
    text = text or ""
    found = []
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    found.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    n = Counter(f[3] for f in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
        len(w) < 50 or 100 * len(hit) > 50 * len(w),
    )


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def pieces(text, tokenizer, capacity=2048):
    import numpy as np

    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % capacity or capacity
    out, start, length = [], 0, first
    while start < len(ids):
        part = ids[start : start + length]
        out.append((start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        start, length = start + len(part), capacity
    return out


def targets(sizes, max_epochs=3):
    """Water level per source: ``sizes`` by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        if not free:
            return {s: float(max_epochs * sizes[s]) for s in sizes}
        level = (total - sum(max_epochs * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > max_epochs * sizes[s]}
        if not over:
            return {s: float(max_epochs * sizes[s]) if s in clamped else weight[s] * level for s in sizes}
        clamped |= over


def shingles(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
