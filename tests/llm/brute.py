"""Plain versions of the operators, written without their methods, for small tables."""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i:i + 5])].append(i)
    repeated = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def shingles(text: str | None, n: int) -> set:
    w = [x.lower() for x in words(text)]  # bytes.lower() changes A-Z only
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_words(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            if key in seen:
                gone.update(range(s, s + length))
            seen.add(key)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out


def shared_bytes(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        own = [raw[s:s + length] for s in range(len(raw) - length + 1)]
        gone = {k for s, x in enumerate(own) if x in seen for k in range(s, s + length)}
        spans = sum(k - 1 not in gone for k in gone)
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        out[i] = len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()
        seen.update(own)
    return out


ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")


def secrets(text: str | None) -> tuple[int, int, int, str]:
    raw = (text or "").encode()

    def at(k: int) -> int:
        return len(raw[:k].decode())

    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if len(m[0]) >= 24]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{at(a)}:{at(b)}" for a, k, b in sorted(found))
    return *(sum(k == x for _, x, _ in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()
