"""Plain Python versions of operators 11 to 13, one row at a time."""

import hashlib
import math
import re
from itertools import permutations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def filter_audit(docs, labels):
    """``docs``: (doc_id, text, source); ``labels``: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in mine) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                alone = sum(r[1] == {f} for r in mine)
                steps.append((part, "".join(order), n + 1, len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def usable(vectors):
    return [(i, np.array(x, np.float32).astype(float)) for i, x, *_ in vectors if i is not None and x and None not in x and np.isfinite(x).all() and np.any(np.array(x, np.float32))]


def neighbours(vectors, asked, k):
    rows = usable(vectors)
    out = []
    for i, x in rows:
        if asked(i):
            others = set()
            for j, y in rows:
                if j != i and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(x.tolist(), y.tolist()):
                        s += a * b
                    others.add((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(others)[:k])]
    return sorted(out)


def clusters(vectors, k=16, rounds=3, dim=64, scale=64):
    rows = []
    for i, x, *_ in vectors:
        if x and len(x) == dim and None not in x and np.isfinite(x).all():
            rows.append((i, [math.floor(scale * float(np.float32(v))) for v in x]))
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centroids = [list(x) for _, x in starts[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids)) for _, x in rows]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(rows, at) if c == n]
            if mine:
                centroids[n] = [sum(v) // len(mine) for v in zip(*mine)]
    at = assign()
    inertia = [sum(d for d, c in at if c == n) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), names[c]) for (i, _), (d, c) in zip(rows, at)]
