"""Small tables and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, kept string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def documents(spark, rows):
    """(doc_id, text) rows as documents, with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "c", "k") for i, t in rows], DOCS)


def groups(rows, percent):
    """Smallest doc_id that each row with an id reaches, by comparing all pairs."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}
