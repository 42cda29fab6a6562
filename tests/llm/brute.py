"""Plain-Python versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(doc_id, parts: int = 5) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def words(text) -> list[str]:
    return WORDS.findall(text or "")


def quality(text) -> tuple[int, ...]:
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text, size: int) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(docs, size: int, percent: int = 80) -> dict:
    sets = {k: shingles(x, size) for k, x in docs if k is not None}
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    held = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            held[g].append(k)
    shared = collections.Counter((a, b) for ks in held.values() for i, b in enumerate(ks) for a in ks[:i])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def listed(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text) -> list:
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
    )
    return (
        [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    )


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text) -> list:
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return found


def unigram(docs) -> tuple[dict, int, int]:
    tokens = {i: [*words((x or "").translate(LOWER)), None] for i, (_, x) in enumerate(docs)}
    counts = collections.Counter()
    for i, (k, _) in enumerate(docs):
        if crc(k) != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    rows = {
        i: (len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for i, t in tokens.items()
    }
    return rows, n, v
