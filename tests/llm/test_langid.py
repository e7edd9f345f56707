"""Hierarchical language identification."""

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import langid

from .common import documents, odd_texts, rng

SYLLABLES = {"aa": "ka lo mi", "ab": "ka lo mu", "ba": "schr tz ung", "bb": "schr tz ang"}


def corpus():
    r = rng(5)
    rows = []
    for i in range(400):
        lang = sorted(SYLLABLES)[i % 4]
        parts = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), "s", lang))
    return rows


def test_held_out_accuracy_and_families(spark):
    docs = documents(spark, corpus()).withColumn("score", F.lit("clash"))
    model = langid.train(docs)
    assert model.languages == sorted(SYLLABLES) and sorted(map(sorted, model.families)) == [[0, 1], [2, 3]]
    held = [r for r in langid.predict(docs, model).collect() if r["held_out"]]
    truth = {i: lang for i, _, _, lang in corpus()}
    assert len(held) > 60 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_odd_rows(spark):
    docs = documents(spark, corpus())
    model = langid.train(docs)
    odd = documents(spark, [(i, t) for i, t in enumerate(odd_texts())] + [(None, "ka lo"), (7, "123 !?"), (7, "123 !?")])
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by[i] == "und" for i in (0, 1, 2)) and by[7] == "und" and by[3] != "und"
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.train(documents(spark, [(1, "a", "s", None), (2, None, "s", "xx")]))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    single = langid.train(documents(spark, [(1, "ka lo", "s", "aa"), (2, "lo", "s", "aa")]))
    assert {r["lang_pred"] for r in langid.predict(odd, single).collect()} == {"aa", "und"}


def test_long_text_features_do_not_depend_on_parts():
    text = "abc déf " * 200_000
    short = langid.features("abc déf " * 100)
    assert abs(langid.features(text) @ short) > 0.999
