"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spans(rows, size=20):
    """{doc_id: (n_words, n_removed, sha)} of unique (doc_id, text) rows."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        w = BLANK.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            if k in seen:
                gone[i:i + size] = [True] * size
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near(rows, percent=80):
    """{doc_id: (n_shingles, component)}."""
    sets = {}
    for doc, text in rows:
        if doc is not None:
            w = BLANK.findall(lower(text))
            sets[doc] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def leaks(rows, items, size=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}."""
    win = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            win[tuple(w[i:i + n])].add(str(item))
    out = {}
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in win}:
            for i in range(len(w) - n + 1):
                k = win.get(tuple(w[i:i + n]))
                if k:
                    found |= k
                    hit[i:i + n] = [True] * n
        out[doc] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


def url_tree(pages, wide=32, weight=2.0, z=1.96, depth=8):
    """{page row number: (template, verdict)} of rows (host, path, said), ``said`` being True, False or None."""
    segs = [["*" if re.search("[0-9]", s) else s for s in p.split("/") if s] for _, p, _ in pages]
    nodes, prefix = [[] for _ in pages], [""] * len(pages)
    for d in range(min(depth, max(map(len, segs), default=0))):
        children = defaultdict(set)
        for (h, _, _), p, s in zip(pages, prefix, segs):
            if len(s) > d:
                children[h, p].add(s[d])
        for i, ((h, _, _), s) in enumerate(zip(pages, segs)):
            if len(s) > d:
                prefix[i] += "/" + ("*" if len(children[h, prefix[i]]) > wide else s[d])
                nodes[i].append(prefix[i])
    counts = defaultdict(lambda: [0, 0])
    for (h, _, said), mine in zip(pages, nodes):
        for key in [(None, None), (h, ""), *((h, n) for n in mine)]:
            counts[key][0] += said is not None
            counts[key][1] += said is True
    pool = {}
    siblings = defaultdict(set)
    for (h, _, _), mine in zip(pages, nodes):
        for parent, n in zip(["", *mine], mine):
            siblings[h, parent].add(n)
    for (h, _), group in siblings.items():
        runs, known = [], [n for n in group if counts[h, n][0]]
        for n in sorted(known, key=lambda n: (counts[h, n][1] / counts[h, n][0], n)):
            k, g = counts[h, n]
            if runs:
                k0, g0 = counts[h, runs[-1][-1]]
                both = (g + g0) / (k + k0)
                if abs(g / k - g0 / k0) <= z * (both * (1 - both) * (1 / k + 1 / k0)) ** 0.5:
                    runs[-1].append(n)
                    continue
            runs.append([n])
        for run in runs + [[n] for n in group if not counts[h, n][0]]:
            total = [sum(counts[h, n][i] for n in run) for i in (0, 1)]
            pool.update({(h, n): total for n in run})
    out = {}
    for i, ((h, _, said), mine) in enumerate(zip(pages, nodes)):
        purity = 0.5
        for k, g in [counts[None, None], counts[h, ""], *(pool[h, n] for n in mine)]:
            purity = (g + weight * purity) / (k + weight)
        out[i] = prefix[i] + "/**" * (len(segs[i]) > depth), said if said is not None else purity >= 0.5
    return out
