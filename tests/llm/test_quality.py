"""Base statistics against plain Python, and verdicts on planted junk."""

import math
from collections import Counter

import regex
from pyspark.sql import functions as F

from corvane.llm import quality

from .common import WORD, documents, hashed, odd_texts, rng, words


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def corpus():
    r = rng(12)
    rows = []
    for i in range(150):
        text = words(r, r.randrange(60, 200))
        if i % 5 == 4:
            text = " ".join(x + r.choice(["###", "&&&", "$$$"]) for x in text.split())
        rows.append((i, text.replace(" e", "\ne") if i % 2 else text))
    rows += [(500 + i, t) for i, t in enumerate(odd_texts())] + [(600, "a b c " * 40), (601, "same line\n" * 30 + words(r, 60)), (602, " ".join(["x"] * 3 + [str(i) for i in range(60)]))]
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (700, "a b c d a b c e a b"), (701, "p q r s p q r s t q r s")]


def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 4)) for i in range(0, 150, 2)] + [(4, None), (None, 1), (99999, 1), (0, 1)], "doc_id long, quality int")


def test_base_columns_and_verdicts(spark):
    df = documents(spark, corpus()).withColumn("kept", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("extra", F.lit(2))
    got = quality.quality_verdicts(df, quality.trusted_ids(labels(spark)))
    assert "extra" in got.columns and "words" not in got.columns
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = got.select(*columns, "kept").collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(((d, *plain(t)) for d, t in corpus()), key=str)
    verdict = {r["doc_id"]: r["kept"] for r in found}
    assert all(verdict[i] == (i % 5 != 4) for i in range(150))
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_reruns_agree(spark):
    df, trusted = documents(spark, corpus()), quality.trusted_ids(labels(spark))
    assert quality.log_ratios(df, trusted) == quality.log_ratios(df.repartition(5), trusted)


def test_without_trusted_texts(spark):
    nothing = labels(spark).limit(0)
    df = documents(spark, corpus())
    got = quality.quality_verdicts(df, quality.trusted_ids(nothing)).collect()
    assert all(r["kept"] != r["base_failed"] and r["llr"] == 0 for r in got)
    assert quality.quality_verdicts(df.limit(0), quality.trusted_ids(labels(spark))).count() == 0


def test_no_python_in_the_plan(spark):
    got = quality.quality_verdicts(documents(spark, corpus()), quality.trusted_ids(labels(spark)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange hash"))


def test_ratios_against_plain_counts(spark):
    """Buckets, counts and verdicts of the multinomials, one n-gram after the other."""
    rows = [(d, t) for d, t in corpus() if d is not None and len(t or "") < 20_000]
    df, buckets = documents(spark, rows), 512
    trusted = {i for i in range(0, 150, 2) if i % 5 != 4} & {d for d, _ in rows}
    marks = spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long")

    def grams(text):
        w = WORD.findall(text or "")
        h = [hashed(x) for x in w]
        shapes = regex.findall(r"[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")
        return h + [hashed(a, b) for a, b in zip(h, h[1:], strict=False)] + [hashed(x, "shape") for x in shapes]

    raw, good = Counter(), Counter()
    for text in {t or "" for _, t in rows}:
        found = [g % buckets for g in grams(text)]
        raw.update(found)
        if any(d in trusted and (t or "") == text for d, t in rows):
            good.update(found)
    share = good.total() / raw.total()
    ratio = {b: round(math.log((good[b] + quality.PRIOR) / (n * share + quality.PRIOR)) / quality.UNIT) for b, n in raw.items()}
    ratios = quality.log_ratios(df, marks, buckets=buckets)
    assert ratios == [ratio.get(b, 0) for b in range(buckets)]
    for r in quality.quality_verdicts(df, marks, buckets=buckets).collect():
        found = [ratio[g % buckets] for g in grams(r["text"])]
        assert abs(r["llr"] - sum(found) * quality.UNIT / max(1, len(found))) < 1e-9
        assert r["kept"] == (not r["base_failed"] and sum(found) >= round(quality.THRESHOLD / quality.UNIT) * len(found))
