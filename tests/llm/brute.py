"""Plain versions of the operators, over a list of (doc_id, text)."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def components(pairs, k, num, den):
    """[(doc_id, size, component)] per pair; pairs of one id are one node."""
    sets = [(i, shingles(t, k)) for i, t in pairs]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def stripped(pairs, window):
    """[(doc_id, words, removed, kept)] in order of (id, text), nulls first."""
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            run = tuple(w[p : p + window])
            if run in seen:
                gone[p : p + window] = [True] * window
            seen.add(run)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
