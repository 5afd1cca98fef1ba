"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def kept_words(texts, window):
    """Words of each text outside windows that occur twice or more."""
    cut = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append([x for x, g in zip(w, gone) if not g])
    return out


def later_bytes(rows, window):
    """Flags of the bytes of each (doc_id, text) under windows that occurred earlier; rows have distinct doc_ids."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(part)
        out[key] = bytes(gone)
    return out


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def groups(rows, size, percent=80):
    """Smallest doc_id that each document reaches; rows have distinct doc_ids."""
    sets = {key: shingles(text, size) for key, text in rows}
    label = {key: key for key in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {key: find(key) for key in keys}
