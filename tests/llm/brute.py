"""Plain in-memory versions of the operators, written from their definitions."""

import hashlib
from collections import defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows, length=100):
    """rows of (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    low = -(1 << 63)
    for i, t in texts:
        for s in range(len(t) - length + 1):
            place = (low if i is None else i, s)
            key = t[s:s + length]
            if key not in first or place < first[key]:
                first[key] = place
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < (low if i is None else i, s):
                gone[s:s + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, sha(kept)))
    return out


def substring_dedup(rows, window=35):
    """rows of (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    count = defaultdict(int)
    for _, w in texts:
        for s in range(len(w) - window + 1):
            count[tuple(w[s:s + window])] += 1
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def simhash_groups(rows, size=4, bits=4):
    """rows of (doc_id, text) -> (doc_id, fingerprint, representative of its group)."""
    import xxhash
    marks = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = low.encode().split()
        grams = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        marks.append((i, fp))
    fps = sorted({fp for _, fp in marks})
    parent = {fp: fp for fp in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= bits and root(a) != root(b):
                parent[root(b)] = root(a)
    return [(i, fp, root(fp)) for i, fp in marks]


def simhash(rows, size=4, bits=4):
    """rows of (doc_id, text) -> (doc_id, fingerprint, component_id)."""
    marks, least = simhash_groups(rows, size, bits), {}
    for i, _, root in marks:
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return [(i, f"{fp:016x}", least.get(root)) for i, fp, root in marks]


def quality(rows):
    """rows of (doc_id, text) -> the base columns."""
    import re
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        spots = defaultdict(list)
        for k in range(len(words) - 4):
            spots[tuple(words[k:k + 5])].append(k)
        inside = {k + d for starts in spots.values() if len(starts) > 1 for k in starts for d in range(5)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), again, len(inside), failed))
    return out


def secrets(rows):
    """rows of (doc_id, text) -> (doc_id, n_assign, n_access, n_hex, base_sha256)."""
    import re
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    out = []
    for i, t in rows:
        spans = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern, group, least) in enumerate(rules)
                 for m in pattern.finditer(t or "") if len(m[group]) >= least]
        counts = [sum(1 for s in spans if s[2] == kind) for kind, *_ in rules]
        out.append((i, *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode())))
    return out


def top_k(rows, every=50, k=5, scale=256):
    """rows of (vec_id, vector) -> (query_id, rank, vec_id, score)."""
    import math
    held = sorted({(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows
                   if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in held:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in held if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def warc(rows, least=100):
    """rows of (page_id, html) -> (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in data:
        if i is not None and len(p) >= least:
            first[p] = min(i, first.get(p, i))
    return [(i, len(p), sha(p), *(("response", None) if first.get(p, i) == i else ("revisit", first[p]))) for i, p in data]
