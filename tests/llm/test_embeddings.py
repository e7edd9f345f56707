"""Embedding links against all pairs."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import embeddings

from .common import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    sound = [(i, np.array(v, dtype=np.float64)) for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = [(i, j) for (i, x), (j, y) in combinations(sound, 2) if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9]
    found = components(links, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[found[i]] = min(least.get(found[i], d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(found[i])
        out.append((d, sum(i in p for p in links), c, d == c))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)


def corpus(size=64):
    r = np.random.default_rng(9)
    f = lambda v: [float(np.float32(c)) for c in v]
    base = [r.standard_normal(size) for _ in range(40)]
    rows = [(i, f(v)) for i, v in enumerate(base)]
    rows += [(100 + i, f(base[i % 4] + 0.15 * r.standard_normal(size))) for i in range(60)]
    rows += [(300 + i, f(base[5])) for i in range(30)] + [(400, f(7 * base[5])), (401, f(-base[5]))]
    rows += [(500, None), (501, [0.0] * size), (502, [float("nan")] * size), (503, [float("inf"), *[0.0] * (size - 1)]), (504, [None, *[1.0] * (size - 1)]), (505, [])]
    rows += [(506, [1.0, 0.0]), (507, [1.0, 0.1]), (508, [-0.0, 1.0]), (509, [0.0, 1.0]), (None, f(base[6])), (None, None), (7, f(base[8]))]
    return rows


def test_against_all_pairs(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in corpus()], SCHEMA).withColumn("node", F.lit("clash")).withColumn("n_links", F.lit(0))
    assert got(df) == expected(corpus())


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert got(df) == [(1, 0, 1, True)] and got(df.limit(0)) == []


def borders(size, cosine, n=1500):
    r = np.random.default_rng(10)
    a = r.standard_normal((n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.standard_normal(a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("size", [8, 64, 768])
@pytest.mark.parametrize("n_bits", [10, 16, 24])
def test_recall_at_the_border(size, n_bits):
    a, b = borders(size, 0.9)
    (bits_a, own, around_a), (bits_b, other, around_b) = embeddings.codes(a, n_bits), embeddings.codes(b, n_bits)
    met = (own[:, :, None] == around_b[:, None, :]).any(axis=(1, 2)) | (other[:, :, None] == around_a[:, None, :]).any(axis=(1, 2))
    share = math.acos(0.9) / math.pi
    most = 64 * share + embeddings.SIGN_SIGMAS * math.sqrt(64 * share * (1 - share))
    assert (met & (np.bitwise_count((bits_a ^ bits_b).view(np.uint64)) <= most)).mean() > 0.98


@pytest.mark.parametrize("n_bits", [10, 14])
def test_chance_meetings_stay_in_proportion(n_bits):
    r = np.random.default_rng(12)
    x = r.standard_normal((2**n_bits, 64))
    _, own, visited = embeddings.codes(x / np.linalg.norm(x, axis=1, keepdims=True), n_bits)
    filed = Counter(own.ravel().tolist())
    meetings = sum(filed[c] for c in visited.ravel().tolist()) - own.size
    assert meetings < 4 * visited.size


def dense(size):
    """Groups of near copies of several widths, some at the border of others."""
    r = np.random.default_rng(size)
    f = lambda v: [float(np.float32(c)) for c in v]
    rows, bases = [], [r.standard_normal(size) for _ in range(4)]
    for base in bases:
        length = np.linalg.norm(base) / math.sqrt(size)
        centres = [base, base + 0.44 * length * r.standard_normal(size), base + 0.3 * length * r.standard_normal(size)]
        for centre, spread in zip(centres, (0.05, 0.12, 0.25), strict=True):
            rows += [f(centre + spread * length * r.standard_normal(size)) for _ in range(60)]
    return list(enumerate(rows + rows[::7]))


@pytest.mark.parametrize(("size", "block"), [(16, 1024), (64, 7)])
def test_dense_groups_against_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = dense(size)
    want = expected(rows)
    links = sum(r[1] for r in want)
    assert links > 20_000
    found = got(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))
    assert sum(r[1] for r in found) >= 0.999 * links and all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert [f[2:] for f in found] == [w[2:] for w in want]


def test_nearest_lattice_points():
    r = np.random.default_rng(11)
    x = 3 * r.standard_normal((300, 8))
    near = embeddings.nearest_e8(x)
    half = near % 1 == 0.5
    assert (half.all(axis=1) | ~half.any(axis=1)).all() and (near.sum(axis=1) % 2 == 0).all()
    assert len(embeddings.neighbours()) == 240
    best = ((x - near) ** 2).sum(axis=1)
    assert all((((x - near - v) ** 2).sum(axis=1) >= best - 1e-9).all() for v in embeddings.neighbours())
