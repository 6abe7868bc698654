"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash

WS = "[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(WS, text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """docs: (doc_id, text) -> doc_id -> (keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(WS, " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g}


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(text)
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def simhash(docs):
    """doc_id -> (fingerprint, component id) by comparing all pairs."""
    fps = {i: fingerprint(t) for i, t in docs}
    keys = sorted({f for f in fps.values()})
    root = {f: f for f in keys}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 4:
                x, y = find(keys[a]), find(keys[b])
                root[x] = y
    first = {}
    for i, f in fps.items():
        r = find(f)
        first[r] = min(first.get(r, i), i)
    return {i: (f"{f:016x}", first[find(f)]) for i, f in fps.items()}


def substring(docs):
    """doc_id -> (n_words, n_removed, sha of the kept words)."""
    least, ws = {}, {i: words(t) for i, t in docs}
    for i, w in ws.items():
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in ws.items():
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def chat(rows):
    """(conv_id, turn, role, text) -> conv_id -> (n_turns, copies, rendered)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: tuple(x[2:] for x in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, t in convs.items():
        if not any(len(u) > len(t) and u[:len(t)] == t for u in convs.values()):
            same = [d for d, u in convs.items() if u == t]
            first = min((d for d in same if d is not None), default=None)
            if c == first:
                out[c] = (len(t), len(same), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t))
    return out


def quality(docs):
    """doc_id -> the counts of the contract and base_failed."""
    out = {}
    for i, t in docs:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        rep = {p for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                  len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
    return out


def sql(text, **tables):
    """Run an oracle over pandas frames."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(text).df()


def ids_digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
