"""Plain restatements of the text operators, for small tables of ``(doc_id, text)`` rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def first(i) -> tuple:
    return (i is not None, i or 0)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def substring(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (first(r[0]), r[1] or "")):
        words, reach, kept = WORD.findall(text or ""), 0, []
        for j, w in enumerate(words):
            window = tuple(words[j : j + length])
            if len(window) == length:
                if window in seen:
                    reach = j + length
                seen.add(window)
            if j >= reach:
                kept.append(w)
        out[i, text] = (len(words), len(words) - len(kept), sha(" ".join(kept)))
    return [(i, *out[i, t]) for i, t in rows]


def repeated_bytes(rows, length=400):
    bodies = [(t or "").encode() for _, t in rows]
    count = Counter(b[j : j + length] for b in bodies for j in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    return out


def near(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i, t] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    groups, least = Sets(), {}
    for (i, _), s in sets.items():
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    nodes = list(least)
    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                groups.join(least[a], least[b])
    out = []
    for i, t in rows:
        s = sets[i, t]
        group = groups.find(least[s]) if s in least else i
        out.append((i, len(s), group, group == i))
    return out


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        groups[n].append(i)
    keep = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    return [(i, keep[n], len(groups[n]), i == keep[n], sha(n)) for (i, _), n in zip(rows, norm)]


def statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    count, covered = Counter(windows), set()
    for j, x in enumerate(windows):
        if count[x] > 1:
            covered |= {j, j + 1, j + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def edit_distance(a, b, most):
    """The edit distance, or ``most + 1`` for any larger one."""
    bags = Counter(a), Counter(b)
    if max((bags[0] - bags[1]).total(), (bags[1] - bags[0]).total()) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def fuzzy_lines(rows, share=0.1):
    import regex

    ids, lines = {}, []
    for i, t in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            norm = regex.sub(r"[^\p{L}]+", " ", line.lower()).strip(" ")
            if norm:
                lines.append((i, k, ids.setdefault(norm, len(ids))))
    names = list(ids)
    groups = Sets()
    for a in range(len(names)):
        for b in range(a):
            most = int(share * max(len(names[a]), len(names[b])))
            if abs(len(names[a]) - len(names[b])) <= most and edit_distance(names[a], names[b], most) <= most:
                groups.join(a, b)
    place, gone = {}, defaultdict(set)
    for i, k, n in sorted(lines, key=lambda x: (first(x[0]), x[1])):
        if place.setdefault(groups.find(n), (i, k)) != (i, k):
            gone[i].add(k)
    return [(i, len(t.split("\n")) if t is not None else 0, len(gone[i]), sorted(gone[i])) for i, t in rows]
