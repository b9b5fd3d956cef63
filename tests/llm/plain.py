"""Plain single-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_data(text: str | None):
    """Counts by kind and the digest of the base spans."""
    spans, counts = [], []
    for kind, pattern in PATTERNS:
        n = 0
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def shingles(text: str | None, k: int = 5) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(rows: list[tuple], similarity: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, pair by pair over shared shingles."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    common: dict = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def without_repeats(rows: list[tuple], window: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256); ids are distinct and not null."""
    first: dict = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k:k + window]), (d, k))
    out = []
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (d, k):
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def tokens(rows: list[tuple], path: str) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) of rows in ascending order of id."""
    import numpy as np
    from tokenizers import Tokenizer
    t, start, out = Tokenizer.from_file(path), 0, []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def top_k(rows: list[tuple], every: int, k: int) -> list[tuple]:
    """(query_id, rank, vec_id, score) of (vec_id, integer components) rows."""
    out = []
    for q, x in rows:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q and len(y) == len(x))[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(found)]
    return out


def mix_targets(sizes: list[tuple], weights=(3, 1, 2)) -> dict:
    """Target of each source of (source, size), by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap, total = {s: 2 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes)
    full: set = set()
    while True:
        left, open_ = total - sum(cap[s] for s in full), [s for s in cap if s not in full]
        if not open_:
            return {s: float(c) for s, c in cap.items()}
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap[s]}
        if not over:
            return {s: float(cap[s]) if s in full else level * w[s] for s in cap}
        full |= over
