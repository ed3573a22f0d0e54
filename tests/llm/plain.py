"""Brute-force readings of the contracts, on plain Python values."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs(spark, texts):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def least_reachable(ids, linked):
    """Least id reachable for each position; ``linked(i, j)`` on positions."""
    n, root = len(ids), list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[top(i)] = top(j)
    best = {}
    for i in range(n):
        if ids[i] is not None:
            best[top(i)] = min(best.get(top(i), ids[i]), ids[i])
    return [best.get(top(i)) for i in range(n)]


def simhash(text):
    words = WS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    words = TOKEN.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for key, body in items:
        iw = TOKEN.findall((body or "").translate(LOWER))
        size = min(13, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(words) - size + 1 if iw else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(key)
    n = len(hit)
    return len(words), n, len(found), sha(",".join(sorted(str(k) for k in found if k is not None))), n > 0 and 20 * n >= len(words)


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def kept_words(rows):
    """(n_words, n_removed, sha) per row (id, text), by windows of 50 words."""
    first = {}
    split = [(i, WS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out.append((len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def cosine_links(rows):
    """(n_links, component) per row (id, vector or None)."""
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    near = lambda i, j: unit[i] is not None and unit[j] is not None and float(unit[i] @ unit[j]) >= 0.95
    comp = least_reachable([i for i, _ in rows], near)
    return [(sum(near(i, j) for j in range(len(rows)) if j != i), comp[i]) for i in range(len(rows))]


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
