"""SimHash components against all pairs."""

from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash

from .common import LOWER, UPPER, WORD, components, documents, odd_texts, rng, words


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    links = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i][1] ^ fps[j][1]).bit_count() <= 3]
    found = components(links, range(len(fps)))
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[found[i]] = min(least.get(found[i], d), d)
    return sorted(((d, f, least.get(found[i])) for i, (d, f) in enumerate(fps)), key=str)


def got(df, **options):
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, **options).collect()), key=str)


def corpus():
    r = rng(1)
    base = [words(r, n) for n in (40, 80, 200, 3, 2)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(60):  # near copies of long texts, one word changed
        w = base[i % 3].split()
        w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, base[0].upper().replace(" ", "\t")) for i in range(40)]  # equal but for case and white space
    rows += [(400 + i, t) for i, t in enumerate(odd_texts())] + [(300, base[0]), (None, base[1]), (None, None)]
    return rows


@pytest.mark.parametrize("list_limit", [simhash.LIST_LIMIT, 1])
def test_against_all_pairs(spark, list_limit):
    df = documents(spark, corpus()).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    assert got(df, list_limit=list_limit) == expected(corpus())


def test_empty(spark):
    assert got(documents(spark, [(1, "a")]).limit(0)) == []


@pytest.mark.parametrize("n", [50, 3500])
def test_links_inside_a_list(n):
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, (n, 16)) @ (1 << np.arange(16))
    values = np.unique(bits.astype(np.uint64)) << np.uint64(5)
    label = simhash._links_inside(values, 1)
    near = [(i, j) for i in range(min(len(values), 400)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 1]
    assert all(label[i] == label[j] for i, j in near)
    assert all(label[label] == label) and len(set(label.tolist())) >= 1


def test_triples_cover_every_five():
    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))
