"""Fixtures and brute-force forms that several tests share."""

import random
import re

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """Rows of (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"{'aeiou'[rng.randrange(5)]}{rng.randrange(vocabulary):x}w" for _ in range(n))


def odd_texts():
    """Null, empty, blank, very long, non-ASCII and control characters."""
    return [None, "", " \t\n", "a", "Ünï cödé ñandú ΣΟΦΟΣ \U0001f600 x y z", "x\x00y \x1c\x1d z", "word " * 30_000, "\n" * 50, "q" * 5000]


def components(links, nodes):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def rng(seed=0):
    return random.Random(seed)


def hashed(*values):
    """Spark's ``xxhash64`` of longs, ints (as pairs of value and 4) and texts, signed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (h >> 63 << 64)
