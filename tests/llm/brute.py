"""Plain versions of what the operators compute."""

import re

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in BLANK.split(text) if w]


def connected(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
