"""Targets, permutations, and mixes of words."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

from .common import WORD, documents, hashed, odd_texts, rng, words


def plain_targets(sizes):
    """By repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 100, "b": 1, "c": 2, None: 50}, {"b": 0, "ä": 7, "A": 900, "z": 10, "": 3}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p"))
    out = [r["p"] for r in df.orderBy("id").collect()]
    assert sorted(out) == list(range(n))
    assert n < 64 or out != list(range(n))


def corpus():
    r = rng(4)
    rows = [(i, words(r, r.randrange(1, 400)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(240)]
    rows += [(900 + i, t, None) for i, t in enumerate(odd_texts())]
    return rows + [(3, rows[3][1], "hot"), (None, "three small words", "s1"), (950, "a b", "tiny")]


def test_takes(spark):
    df = documents(spark, corpus()).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(-1))
    got = mixing.mix_takes(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in corpus())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sizes = Counter()
    for _, t, s in corpus():
        sizes[s] += len(WORD.findall(t or ""))
    want, by = plain_targets(sizes), {(sizes[s], round(t, 6)): s for s, t in plain_targets(sizes).items()}
    taken = Counter()
    for r in got:
        taken[by[r["source_size"], round(r["target"], 6)]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in want)
    again = mixing.mix_takes(df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_texts_hold_the_words_taken(spark):
    df = documents(spark, [r for r in corpus() if r[0] != 3])
    takes = {r["doc_id"]: r["taken"] for r in mixing.mix_takes(df).collect()}
    mix = mixing.mix_documents(df)
    assert mix.columns == df.columns
    texts, counted = {d: t for d, t, _ in corpus()}, Counter()
    for r in mix.collect():
        counted[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert not Counter(WORD.findall(r["text"])) - Counter(WORD.findall(texts[r["doc_id"]]))
    assert all(counted[d] == n for d, n in takes.items())


def test_empty(spark):
    df = documents(spark, [(1, "a", "s")]).limit(0)
    assert mixing.mix_takes(df).count() == 0 and mixing.mix_documents(df).count() == 0
    blank = documents(spark, [(1, None, "s"), (2, "", None)])
    assert [r["taken"] for r in mixing.mix_takes(blank).collect()] == [0, 0]


def moved(x, n, salt):
    for turn in range(1, mixing.ROUNDS + 1):
        other = (hashed(salt, (turn, 4)) % n - x) % n
        low = hashed(max(x, other), (turn, 4), salt)
        x = other if low % 2 else x
    return x


def plain_takes(rows, block_words, shard_slots, seed):
    """The mix of rows (doc_id, text, source), one slot after the other."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    of = Counter()
    for (_, _, s), n in zip(rows, sizes, strict=True):
        of[s] += n
    targets = plain_targets(of)
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    n_buckets = max(1, math.ceil(math.sqrt(len(rows)) / 4))
    laid, taken = {}, [0] * len(rows)
    for rank, s in enumerate(names):
        key = lambda i: (hashed(rows[i][0], hashed_text(rows[i][1])) % n_buckets, rows[i][0], hashed_text(rows[i][1]))
        laid[rank] = [(i, w) for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=key) for w in range(sizes[i])]
    blocks = {r: math.ceil(len(x) / block_words) for r, x in laid.items()}
    slots = {r: round(targets[s] * blocks[r] / of[s]) if of[s] else 0 for r, s in enumerate(names)}
    total, ends, at = sum(slots.values()), [], 0
    for r in laid:
        at += slots[r]
        ends.append(at)
    shards = Counter()
    for i in range(total):
        draw = hashed(i, seed) % total
        shards[i // shard_slots, next(r for r, e in enumerate(ends) if draw < e)] += 1
    drawn, over, out = Counter(), Counter(), []
    for (_, r), n in sorted(shards.items()):
        drawn[r] += n
    for r in laid:
        for k in range(drawn[r]):
            number = moved(k, drawn[r], hashed((r, 4), "deal"))
            if number >= slots[r]:
                over[r] += 1
            else:
                out.append((r, number))
        out += [(r, number) for number in range(drawn[r], slots[r])]
    assert all(n == max(0, drawn[r] - slots[r]) for r, n in over.items())
    for r, number in out:
        span = min(max(drawn[r], slots[r]), 3 * blocks[r])
        index = moved(number, span, hashed((r, 4), "blocks"))
        block = moved(index % blocks[r], blocks[r], hashed((r, 4), (index // blocks[r], 4)))
        for i, _ in laid[r][block * block_words : (block + 1) * block_words]:
            taken[i] += 1
    return taken


def hashed_text(t):
    return 42 if t is None else hashed(t)


def drawn_corpus():
    r = rng(14)
    return [(i, words(r, r.randrange(0, 300)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(150)] + [(400, None, "s1"), (401, "a b c", None)]


@pytest.mark.parametrize("seed", [42, 7])
def test_takes_against_plain_python(spark, seed):
    rows = drawn_corpus()
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_takes(documents(spark, rows), block_words=16, shard_slots=100, seed=seed).collect()}
    assert [got[d] for d, _, _ in rows] == plain_takes(rows, 16, 100, seed)


def test_the_draw_decides(spark):
    one, other = (mixing.mix_takes(documents(spark, drawn_corpus()), block_words=16, shard_slots=100, seed=s).collect() for s in (42, 7))
    assert sorted(map(tuple, one), key=str) != sorted(map(tuple, other), key=str)


def test_shards_are_multinomial_draws(spark):
    """Counts of a source scatter over the shards as those of a multinomial."""
    plan = spark.createDataFrame([(0, 1, 30_000, 0), (1, 1, 60_000, 30_000), (3, 1, 10_000, 90_000)], "rank int, n_blocks long, n_slots long, first long")
    counts = mixing.draw_counts(plan, 100_000, 500).collect()
    assert sum(r["n"] for r in counts) == 100_000
    for rank, p in ((0, 0.3), (1, 0.6), (3, 0.1)):
        own = [r["n"] for r in counts if r["rank"] == rank]
        chi = sum((n - 500 * p) ** 2 for n in own) / (500 * p * (1 - p))
        assert len(own) == 200 and 150 < chi < 260


def test_blocks_fill_shards(spark):
    rows = drawn_corpus()
    got = mixing.mix_blocks(documents(spark, rows), block_words=16, shard_slots=100).collect()
    shards = Counter(s for s, _ in {(r["shard"], r["slot"]) for r in got})
    assert all(n == 100 for s, n in shards.items() if s < max(shards)) and {r["slot"] for r in got} <= set(range(100))
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["n"]
    assert [taken[d] for d, _, _ in rows] == plain_takes(rows, 16, 100, 42)


def test_repeated_ids_over_other_splits(spark):
    r = rng(15)
    rows = [(i % 9 if i % 2 else None, words(r, 90), f"s{i % 2}") for i in range(80)]
    df = documents(spark, rows).withColumn("_row_0", F.lit(1)).withColumn("_take_0", F.lit(2))
    found = [sorted(map(str, f(d).collect())) for f in (mixing.mix_takes, mixing.mix_documents) for d in (df, df.repartition(7), df.orderBy("text"))]
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5]
