"""Components of shingle Jaccard against all pairs, and the rows that the pipeline's stage keeps."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import simhash
from corvane.llm.workspace import Workspace

from .common import WORD, components, documents, odd_texts, rng, words


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return len(a & b) * 10 >= len(a | b) * 8


def corpus():
    """Chains of near copies around Jaccard 0.8, and exact copies, of several texts."""
    r, rows = rng(5), []
    for base in range(6):
        text = words(r, r.choice([60, 150, 300])).split()
        rows.append((base * 100, " ".join(text)))
        for i in range(1, 60):
            w = list(text)
            for _ in range(max(1, len(w) // r.choice([40, 50, 60, 80]))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((base * 100 + i, " ".join(w)))
    return rows + [(1000 + i, rows[0][1]) for i in range(30)] + [(2000 + i, t) for i, t in enumerate(odd_texts())]


@pytest.mark.parametrize(("pair_limit", "block_shingles"), [(simhash.PAIR_LIMIT, simhash.BLOCK_SHINGLES), (4, 2000)])
def test_against_all_pairs(spark, pair_limit, block_shingles):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if near(sets[i], sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in links) > 100
    want = components(links, range(len(rows)))
    df = documents(spark, rows).select(F.col("doc_id").alias("row"), "text")
    got = {r["row"]: r["component"] for r in simhash.near_copies(df, "row", pair_limit=pair_limit, block_shingles=block_shingles).collect()}
    assert len(got) == len(rows)
    groups = lambda label: sorted(map(sorted, _by(label).values()))
    assert groups(got) == groups({d: want[i] for i, (d, _) in enumerate(rows)})


def _by(label):
    out = {}
    for k, v in label.items():
        out.setdefault(v, []).append(k)
    return out


def test_one_row_of_each_group(spark):
    r = rng(6)
    text = [words(r, 80) for _ in range(12)]
    changed = text[0].split()
    changed[40] = "other"
    rows = [(None, t) for t in text[:6]] + [(7, t) for t in text[6:10]] + [(3, " ".join(changed)), (3, text[10]), (9, text[6]), (8, text[11]), (8, text[11])]
    kept = corpus_pipeline.near_duplicates_stage(spark, documents(spark, rows), "").collect()
    want = [(None, t) for t in text[1:6]] + [(7, t) for t in text[6:10]] + [(3, " ".join(changed)), (3, text[10]), (8, text[11])]
    assert sorted(((k["doc_id"], k["text"]) for k in kept), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    assert corpus_pipeline.near_duplicates_stage(spark, documents(spark, [(1, "a")]).limit(0), "").count() == 0


def test_close_copies_meet_by_fingerprint_bytes(spark):
    """Long texts with a word changed are found by SimHash alone, and only by whole sets do they count."""
    r, rows = rng(8), []
    for base in range(20):
        text = words(r, 1500).split()
        rows.append((2 * base, " ".join(text)))
        text[700] = "changed"
        rows.append((2 * base + 1, " ".join(text)))
    ws = Workspace(spark, "test")
    signed = simhash._signed(documents(spark, rows), "doc_id", "text").toPandas()
    nodes = spark.createDataFrame(signed[["node", "fp", "n"]])
    name = dict(zip(signed["node"], signed["row"], strict=True))
    fp = dict(zip(signed["row"], signed["fp"], strict=True))
    want = {(i, i + 1) for i in range(0, 40, 2) if ((fp[i] ^ fp[i + 1]) & (2**64 - 1)).bit_count() <= 3}
    found = {tuple(sorted((name[p["u"]], name[p["v"]]))) for p in simhash._close_pairs(ws, nodes).collect()}
    assert len(want) >= 10 and found == want
    same = spark.createDataFrame([(5, 9, 3), (7, 9, 4), (8, 8, 6), (6, -1, 0)], "node long, fp long, n long")
    assert sorted(map(tuple, simhash._close_pairs(ws, same).collect())) == [(5, 7, 3, 4), (5, 8, 3, 6)]
