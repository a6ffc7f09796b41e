"""Plain, quadratic or whole-corpus restatements that the operators are tested against."""
from __future__ import annotations

import hashlib
import re

import xxhash

BREAK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BREAK.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text, size=3):
    w = words(lower(text))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows, size=3):
    """rows: (doc_id, text) -> {doc_id: (hex, component)}"""
    fps = {i: simhash(t, size) for i, t in rows}
    by_fp = {}
    for i, f in fps.items():
        by_fp.setdefault(f, []).append(i)
    distinct = sorted(by_fp)
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for f in distinct:
        least[find(f)] = min([least.get(find(f), 1 << 70), *by_fp[f]])
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fps.items()}


def cut_repeats(rows, size=20):
    first = {}
    held = [(i, words(t)) for i, t in sorted(rows)]
    for i, w in held:
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p:p + size]), (i, p))
    out = {}
    for i, w in held:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] < (i, p):
                gone.update(range(p, p + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def delete_lines(rows, min_chars=40):
    seen, held = {}, []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        trimmed = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
        for p in range(len(lines)):
            for size in (1, 2):
                seen.setdefault(tuple(trimmed[p:p + size]) if p + size <= len(lines) else None, (i, p))
        held.append((i, lines, trimmed))
    out = {}
    for i, lines, x in held:
        gone = {p for p in range(len(x)) if len(x[p]) >= min_chars and seen[(x[p],)] < (i, p)}
        p = 0
        while p < len(x):
            q = p
            while q + 1 < len(x) and seen[(x[q], x[q + 1])] < (i, q):
                q += 1
            if q > p and sum(map(len, x[p:q + 1])) >= min_chars:
                gone.update(range(p, q + 1))
            p = q + 1
        out[i] = ("\n".join(y for k, y in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out
