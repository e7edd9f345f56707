"""Verdicts on texts with many copies, labelled or not."""

from corvane.llm import quality

from .common import documents, rng, words


def test_unlabelled_copies_of_clean_texts_stay(spark):
    r = rng(21)
    rows = []
    for i in range(240):
        text = words(r, r.randrange(60, 150))
        rows.append((i, " ".join(x + "###" for x in words(r, 100, 4).split()) if i % 6 == 5 else text))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies of a labelled text, none of them labelled
    rows += [(2000 + i, rows[1][1]) for i in range(300)]  # neither the text nor its copies are labelled
    labels = spark.createDataFrame([(i, int(i % 6 != 5)) for i in range(0, 240, 2)], "doc_id long, quality int")
    verdict = {x["doc_id"]: x["kept"] for x in quality.quality_verdicts(documents(spark, rows), quality.trusted_ids(labels)).collect()}
    assert [i for i in range(240) if verdict[i] != (i % 6 != 5)] == []
    assert all(verdict[1000 + i] and verdict[2000 + i] for i in range(300))
