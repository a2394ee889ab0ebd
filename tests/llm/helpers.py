"""Plain models that the operators of the subpackage are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def grams(text, n=5):
    found = words(text)
    n = min(n, len(found))
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if found else set()


def classes(nodes, links):
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}
