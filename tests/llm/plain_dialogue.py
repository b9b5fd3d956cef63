"""A plain single-machine version of conversation repair."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

INITIALS = {"u": "user", "a": "assistant"}
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows: list[tuple]) -> dict:
    """Conversation to its damaged (turn, role, text) rows in order."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv] += []
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        by[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda q: (q[0] is not None, q[0] or 0, q[1])) for c, r in by.items()}


def with_inserts(paths: dict) -> dict:
    for _ in range(3):
        for state, (cost, audit, turns) in list(paths.items()):
            for letter, role in INITIALS.items():
                to = MOVES.get((state, letter))
                new = (cost + 5, audit + "I", [*turns, f"{role}:"])
                if to is not None and (to not in paths or new < paths[to]):
                    paths[to] = new
    return paths


def repaired(turns: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of the ordered turns of a conversation: whole paths, turn by turn."""
    known = [t for t, _, _ in turns if t is not None]
    seen, faults = set(), []
    for _, role, text in turns:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((role, text))
    paths = with_inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(turns, faults):
        after: dict = {}
        for state, (cost, audit, done) in paths.items():
            edits = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                edits += [(MOVES[state, role[:1]], extra, "K", [f"{role}:{text}"])] if (state, role[:1]) in MOVES else []
                edits += [(MOVES[state, x], 1 + extra, "R", [f"{name}:{text}"]) for x, name in INITIALS.items() if (state, x) in MOVES]
            for to, price, edit, line in edits:
                new = (cost + price, audit + edit, done + line)
                if to not in after or new < after[to]:
                    after[to] = new
        paths = with_inserts(after)
    cost, audit, lines = min(paths[s] for s in (0, 3) if s in paths)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
