"""Restoring obfuscated words, and learning from labels."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import toxicity

from .common import documents, odd_texts, rng, words

BAD = ("grumbold", "snarvik", "plonker")


@pytest.fixture(scope="module")
def learned(spark):
    r, rows, labels = rng(3), [], []
    for i in range(400):
        text = words(r, 60)
        bad = i % 4 == 0
        if bad:
            w = text.split()
            for _ in range(3):
                w[r.randrange(len(w))] = BAD[r.randrange(3)]
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts())] + [(5, rows[5][1]), (None, rows[0][1])]
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(0))
    marks = spark.createDataFrame([*labels, (0, 1), (None, 1), (7, None), (77777, 1)], "doc_id long, toxic int")
    return docs, marks, toxicity.train(docs, marks)


def test_held_out_accuracy(learned):
    docs, marks, model = learned
    rows = {(r["doc_id"], r["score"]): r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    held = [r for r in rows.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 50 and all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held)
    assert toxicity.score(docs, model).count() == docs.count()


@pytest.mark.parametrize("written", ["gr0mb0ld", "g r u m b o l d", "sn@rv1k", "grumboooold", "p.l.o.n.k.e.r", "p l 0 n k e r", "5narvik", "pl*nker"])
def test_obfuscated(learned, written):
    model = learned[2]
    expect = {"gr0mb0ld": 0}.get(written, 1)  # a wrong letter stays wrong
    assert bool(model.restorer.words(f"a1w {written} e2w") & set(BAD)) == bool(expect)
    if expect:
        assert model.score(f"a1w {written} e2w") > model.score("a1w e2w")


def test_every_position(learned):
    """Each letter of each word that has a look-alike, at any place, the ends included."""
    restorer, written = learned[2].restorer, 0
    for word in BAD:
        for i, c in enumerate(word):
            for mark in (m for m, meant in toxicity.LOOKS_LIKE.items() if c in meant and m not in "|+€(*"):
                written += 1
                assert word in restorer.words(f"e1w {word[:i]}{mark}{word[i + 1 :]} a2w"), (word, i, mark)
    assert written > 10
    assert "snarvik" in restorer.words("e1w $ n a r v ! k a2w") and "plonker" in restorer.words("p1onk3r")


def all_readings(restorer, span):
    """The likeliest reading by going through all of them."""
    best = None
    for choice in product(*restorer.lattice(span)):
        text, score, a, b = "", 0.0, 0, 0
        for piece, cost in choice:
            score, text = score - cost, text + piece
            if piece in toxicity.LOOKS_LIKE:
                score, a, b = score + (restorer.log_p[a, b, 0] if b else 0), 0, 0
            elif piece:
                c = 0 if piece == " " else toxicity._NUMBER.get(piece, toxicity.SYMBOLS - 1)
                score, a, b = score + restorer.log_p[a, b, c], b, c
        score += restorer.log_p[a, b, 0] if b else 0
        if best is None or score > best[0] + 1e-9:
            best = score, {text}
        elif abs(score - best[0]) <= 1e-9:
            best[1].add(text)
    return best[1]


@pytest.mark.parametrize("span", ["gr0mb0ld", "p1onk3r", "5n4rv1k", "a1w2", "s n 4 r", "p.1.o n", "aaab1", "no1!", "$n@rv!k", "e e", "1l1", "x99"])
def test_viterbi_against_all_readings(learned, span):
    restorer = learned[2].restorer
    assert restorer.restore(span) in all_readings(restorer, span)


def test_scores_against_plain_sums(learned):
    docs, _, model = learned
    for r in toxicity.score(docs.filter("doc_id < 60"), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = Counter(toxicity.WORD.findall(model.restorer.text(r["text"])))
        begun = {w: min(1.0, sum(n for x, n in words.items() if len(x) >= len(w) - 1 and x.startswith(w[:-1])) / words.total() / toxicity.OFTEN) for w in model.weights if w.endswith("*")}
        total = model.bias + sum(x * (begun[w] if w in begun else float(w in words)) for w, x in model.weights.items())
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_equal_rows_and_ties_score_alike(learned):
    docs, marks, model = learned
    twice = docs.union(docs).filter("doc_id < 40")
    scores = {}
    for r in toxicity.score(twice, model).collect():
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert sum(len(v) > 1 for k, v in scores.items() if k != 5) == 0
    again = toxicity.train(docs.repartition(5), marks)
    assert again.weights.keys() == model.weights.keys() and abs(again.bias - model.bias) < 1e-6


def test_plain_text_is_left_alone(learned):
    restorer = learned[2].restorer
    for text in ("plain words, and more.", "in 2024 we had 3 of 10", "what?! no!!", "a | b | c", "x y", "e1w 3 a2w", "! a - b"):
        assert restorer.text(text) == text
    assert restorer.text(None) == ""


def test_counts_cover_every_text(spark):
    df = documents(spark, [(1, "ab"), (2, None), (3, "ab ab"), (4, "ba" * 700_000)])
    counts = {r["trigram"]: r["n"] for r in toxicity.character_counts(df).collect()}
    number = lambda *s: s[0] * 4096 + s[1] * 64 + s[2]
    assert counts[number(0, 0, 1)] == 2 and counts[number(0, 1, 2)] == 3 and counts[number(1, 2, 1)] == 699_999
    assert toxicity.character_counts(df.limit(0)).count() <= 1


def test_probabilities_add_up():
    p = np.exp(toxicity.language_model({5: 3, 64 * 64 + 2: 9}))
    assert np.allclose(p.sum(axis=2), 1)


def test_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] < 0.01 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).count() == 0
