"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def shingle_set(text, words):
    found = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_groups(rows, words, percent):
    """Rows by number: size of the shingle set, and the set of rows in its component."""
    sets = [shingle_set(t, words) for _, t in rows]
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in having[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [(len(s), groups[find(i)]) for i, s in enumerate(sets)]


def windows(items, size=10):
    """Items (as strings) of each window of words."""
    out = defaultdict(set)
    for item, text in items:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            out[tuple(words[k : k + size])].add(str(item))
    return out


def leaks(text, found):
    """Number of words, words inside a window, and items."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, items = set(), set()
    for size in {len(w) for w in found}:
        for k in range(len(words) - size + 1):
            own = found.get(tuple(words[k : k + size]))
            if own:
                items |= own
                hit.update(range(k, k + size))
    return len(words), len(hit), items


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _is_card(match):
    digits = re.sub("[ -]", "", match)
    return 14 <= len(digits) <= 19 and luhn(digits)


PERSONAL = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", _is_card),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def personal(text):
    """Base spans: start, kind, stop."""
    return sorted(
        (m.start(), k, m.end())
        for k, (pattern, valid) in enumerate(PERSONAL)
        for m in re.finditer(pattern, text or "")
        if valid(m.group())
    )
