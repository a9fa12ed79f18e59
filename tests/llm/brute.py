"""Plain single-process versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def ngram_join(docs, k=4, percent=85):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    same = Counter()
    for ds in where.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                same[a, b] += 1
    edges = [(a, b) for (a, b), n in same.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    c = components(sets, edges)
    return {d: (len(s), c[d]) for d, s in sets.items()}


def embedding_links(rows, threshold=0.98):
    """rows: (vec_id, vector, label) -> {vec_id: (n_links, component_id)}"""
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v is not None and not any(x is None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    edges = []
    for label in {l for _, _, l in ok}:
        own = [(i, v) for i, v, l in ok if l == label]
        for n in {len(v) for _, v in own}:
            ids = [i for i, v in own if len(v) == n]
            x = np.array([v for _, v in own if len(v) == n])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            edges += [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)]
    c = components([r[0] for r in rows], edges)
    n = Counter(x for e in edges for x in e)
    return {r[0]: (n[r[0]], c[r[0]]) for r in rows}


def dedup_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text):
    found = []
    for no, (kind, rx, group, least) in enumerate(SECRETS):
        found += [(m.start(), no, f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(text or "") if len(m.group(group)) >= least]
    n = Counter(f[1] for f in found)
    return n[0], n[1], n[2], hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def base_scores(docs, parts=10):
    """docs: (doc_id, text) -> {doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    tok = {d: [*words((t or "").translate(LOWER)), None] for d, t in docs}
    c = Counter(x for d, ts in tok.items() if fold(d, parts) for x in ts)
    n, v = sum(c.values()), len(c)
    return {d: (len(ts), sum(x in c for x in ts), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for d, ts in tok.items()}


def edit_distance_within(pattern, text):
    """Least edit distance of pattern to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def targets(sizes, weights=(5, 2, 1), ratio=1.5, repeat=2):
    """sizes: {source: words} -> {source: target}"""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, budget, out = set(order), ratio * sum(sizes.values()), {}
    while left:
        share = {s: budget * w[s] / sum(w[x] for x in left) for s in left}
        full = {s for s in left if share[s] > repeat * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = repeat * sizes[s]
            budget -= out[s]
        left -= full
    return out
