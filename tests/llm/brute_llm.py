"""What the operators should return, as plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated(sequences, width):
    """For each sequence, which symbols lie in a window that also starts elsewhere."""
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mask = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                mask[i : i + width] = True
        out.append(mask)
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def components(rows, percent=75):
    """(doc_id, text) rows -> a group number for each row; rows of empty sets stand alone."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
        for g in s:
            where[g].append(i)
    return sets, group


SECRETS = (
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
)


def secrets(text):
    a, k, h = SECRETS
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in k.finditer(text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in h.finditer(text) if len(m[0]) >= 24])
