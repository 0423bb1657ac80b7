"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

DATA = "/root/testdata/sf0.001"
VOCABULARY = os.path.join(os.environ.get("RAINLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def measures(text):
    w = words(text)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingles(text, size=5):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) <= size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard_groups(sets, similarity=0.8):
    """Roots of the components of all pairs with that similarity, by an inverted index without limits."""
    groups, seen = Union(len(sets)), defaultdict(list)
    for n, s in enumerate(sets):
        common = Counter(m for x in s for m in seen[x])
        for m, k in common.items():
            if k >= similarity * (len(s) + len(sets[m]) - k):
                groups.join(n, m)
        for x in s:
            seen[x].append(n)
    return [groups.root(n) for n in range(len(sets))]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def docs_of(spark, texts, source="s"):
    return documents(spark, [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)])
