"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


def fingerprint(text, size):
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, distance):
    """The class number of each fingerprint, by comparing all pairs."""
    label = list(range(len(fingerprints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fingerprints))]


def near_classes(texts, size, alike):
    """The class number of each text: all pairs by exact similarity of their distinct shingles."""

    def shingles(text):
        found = [w.lower() for w in words(text)]
        return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    empty = [i for i, s in enumerate(sets) if not s]
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        near = [j for j, n in shared.items() if n >= alike * (len(s) + len(sets[j]) - n)]
        for j in near if s else empty[:1]:
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def cleaned(docs, least):
    """docs: (id, text, site) with ids of their own -> {id: text} without boilerplate lines."""
    bare = lambda line: line.strip(" \t\r")
    sites, first = defaultdict(set), {}
    for i, text, site in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        for n, line in enumerate(lines):
            if bare(line):
                first.setdefault(bare(line), (i, n))
                if site is not None:
                    sites[bare(line)].add(site)
    stays = lambda line, at: len(sites[bare(line)]) < least or first[bare(line)] == at
    return {i: "\n".join(line for n, line in enumerate((text or "").split("\n")) if stays(line, (i, n))) for i, text, site in docs}


def draws(docs, power, seed, rounds=300):
    """docs: (id, text, source, lang) -> {id: (weight, probability, kept)} by fitting to the marginals of a table of powers."""
    cells, where = Counter(), {}
    for i, text, source, lang in docs:
        n = len(words(text))
        digits = Counter(md5(w).hexdigest()[0] for w in set(words(text)) if len(w.decode()) >= 8)
        topic = "topic-" + min(digits, key=lambda d: (-digits[d], d)) if digits else "none"
        where[i] = (source or "unknown", lang or "unknown", topic)
        cells[where[i]] += n
    total = sum(cells.values())
    target = []
    for d in range(3):
        shares = Counter()
        for cell, n in cells.items():
            if n:
                shares[cell[d]] += n**power
        target.append({k: s / sum(shares.values()) * total for k, s in shares.items()})
    factor = [dict.fromkeys(t, 1.0) for t in target]
    weight = lambda cell: math.prod(f.get(v, 1.0) for f, v in zip(factor, cell))
    for _ in range(rounds):
        for d in range(3):
            held = Counter()
            for cell, n in cells.items():
                held[cell[d]] += n * weight(cell)
            for k in target[d]:
                factor[d][k] *= target[d][k] / held[k]
    most = max(weight(c) for c, n in cells.items() if n)
    chance = lambda i: int(md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / 16**13
    return {i: (weight(c), min(1.0, weight(c) / most), chance(i) < min(1.0, weight(c) / most)) for i, c in where.items()}
