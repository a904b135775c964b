"""Plain Python versions of the operators, for small tests."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    found = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def pii_digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in pii(text)).encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard_components(rows, width, num, den):
    """rows: (doc_id, text); gives {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    inverted = {}
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    both = Counter((a, b) for ds in inverted.values() for a in ds for b in ds if a < b)
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}
