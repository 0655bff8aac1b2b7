"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def suffix(texts, length):
    data, seen = [(t or "").encode() for t in texts], defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i))
    cover = [bytearray(len(b)) for b in data]
    for v in seen.values():
        if len(v) > 1:
            for d, i in v:
                cover[d][i : i + length] = b"\1" * length
    out = []
    for b, c in zip(data, cover, strict=True):
        n = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((len(b), sum(c), n, hashlib.sha256(bytes(x for x, y in zip(b, c, strict=True) if not y)).hexdigest()))
    return out


def quality(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at, cover = defaultdict(list), set()
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def line_removal(docs, k=8, threshold=0.8):
    """(doc_id, line) to cut, for (doc_id, text) with distinct ids."""
    where = defaultdict(list)
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                where[line.strip(" ")].append((i, n))
    lines = list(where)
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} or {x} for x in lines]
    u, idx = Union(range(len(lines))), defaultdict(list)
    for i, s in enumerate(sets):
        c = Counter(j for x in s for j in idx[x])
        for x in s:
            idx[x].append(i)
        for j, n in c.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-12 and u.find(i) != u.find(j):
                u.join(i, j)
    groups = defaultdict(list)
    for i, x in enumerate(lines):
        groups[u.find(i)].extend(where[x])
    return {x for v in groups.values() for x in v if x != min(v)}


def ngram_components(docs, k=4, num=85, den=100):
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    u, idx = Union(sets), defaultdict(list)
    for i, s in sets.items():
        c = Counter(j for x in s for j in idx[x])
        for x in s:
            idx[x].append(i)
        for j, n in c.items():
            if den * n >= num * (len(s) + len(sets[j]) - n) and u.find(i) != u.find(j):
                u.join(i, j)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def decontamination(docs, items, window=10):
    w_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    at = defaultdict(set)
    for i, t in items:
        w = w_of(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            at[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = w_of(t), set(), set()
        for n in {len(x) for x in at}:
            for k in range(len(w) - n + 1):
                x = tuple(w[k : k + n])
                if x in at:
                    hit.update(range(k, k + n))
                    found |= at[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def mixing(docs, weights=(3, 1, 2), share=1.5, cap=2.0, packet=256):
    """{doc_id: (size, target, taken)} for (doc_id, source, text)."""
    size = {i: len(words(t)) for i, _, t in docs}
    total = defaultdict(int)
    for i, s, _ in docs:
        total[s] += size[i]
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, left = {}, dict(w)
    budget = share * sum(total.values())
    while left:
        level = budget / sum(left.values())
        over = [s for s in left if left[s] * level >= cap * total[s]]
        if not over:
            target |= {s: v * level for s, v in left.items()}
            break
        for s in over:
            target[s] = cap * total[s]
            budget -= target[s]
            del left[s]
    at, packets = defaultdict(int), []
    key = lambda i, t: hashlib.md5(f"{'text:' + (t or '') if i is None else i}:0".encode()).hexdigest()
    for i, s, t in sorted(docs, key=lambda d: key(d[0], d[2])):
        for again in (0, 1):
            for j in range(0, size[i], packet):
                to = min(size[i], j + packet)
                end = again * total[s] + at[s] + to
                packets.append((end / target[s], s is None, s or "", end, to - j, i))
        at[s] += size[i]
    taken, left = dict.fromkeys(size, 0), int(min(share, cap) * sum(total.values()))
    for *_, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return {i: (size[i], target[s], taken[i]) for i, s, _ in docs}
