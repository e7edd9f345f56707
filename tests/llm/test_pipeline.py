"""The pipeline's stages, each judged on its own input."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm.workspace import Workspace

from .common import WORD, components, documents, odd_texts, rng, words
from .test_linededup import expected as plain_lines
from .test_near_copies import near as alike
from .test_near_copies import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows = rng(13), []
    for i in range(120):
        text = words(r, r.randrange(60, 150))
        if i % 6 == 5:
            text = " ".join(x + "###" for x in text.split())
        rows.append((i, text + ("\na licence line that many of the texts share" if i % 2 else ""), f"s{i % 4}"))
    rows += [(200 + i, rows[0][1], "hot") for i in range(60)] + [(300, None, "s1"), (301, "", None), (302, "too short", "s2"), (None, rows[1][1], "s1")]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5)) for i in range(0, 120)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    ws, docs, seen = Workspace(spark, "pipeline-test"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder)
        seen.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in ws.save(rows, name).collect()]))
        assert name == "packing" or rows.columns == COLUMNS
        docs = ws.load(name, rows)
    quality, lines, near, mix, pack = seen
    clean = {r["doc_id"] for r in quality[1] if r["text"] and len(WORD.findall(r["text"])) >= 50 and "###" not in r["text"]}
    assert {r["doc_id"] for r in quality[2]} == clean and all(r in quality[1] for r in quality[2])
    want = plain_lines([(r["doc_id"], r["text"]) for r in lines[1]])
    assert sorted(((r["doc_id"], r["text"]) for r in lines[2]), key=str) == sorted(((d, t) for d, _, _, t in want), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lines[2])
    sets = [shingles(r["text"]) for r in near[1]]
    found = components([(i, j) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])], range(len(sets)))
    assert Counter(near[1].index(r) for r in near[2]).keys() <= set(range(len(sets))) and len(near[2]) == len(set(found.values()))
    assert {found[near[1].index(r)] for r in near[2]} == set(found.values())
    size = lambda rows: Counter(r["doc_id"] for r in rows for _ in WORD.findall(r["text"]))
    before, after = size(mix[1]), size(mix[2])
    assert all(after[d] <= 3 * before[d] for d in after) and abs(after.total() - before.total()) < 0.1 * before.total()
    by = {}
    for r in pack[2]:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(x) <= 2048 for x in by.values()) and sum(r["piece"] == 0 for r in pack[2]) == len(pack[1])


def test_run(spark, folder):
    done = corpus_pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and done.count() > 0


CLASHES = ["words", "shapes", "kept", "row", "document", "_row", "_left", "kept_text", "n_lines", "_size", "size", "taken", "component", "llr", "base_failed"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_pass_through(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    r = rng(17)
    rows = [(i, words(r, 80), f"s{i % 2}") for i in range(20)] + [(None, words(r, 80), None), (None, words(r, 80), None), (5, words(r, 80), "s1")]
    docs = documents(spark, rows)
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("source")))
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(x[c] == (None if x["source"] is None else c + x["source"]) for x in found for c in CLASHES)
    if name != "mixing":
        assert len(found) == len(rows)  # nothing here is junk, repeated or a copy


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows_and_odd_rows(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark, [(i % 5, t, None) for i, t in enumerate(odd_texts())] + [(None, None, None)] * 3)
    assert stage(spark, docs.limit(0), folder).count() == 0
    assert stage(spark, docs, folder).count() >= (name != "quality")
