"""Line deduplication against plain counting."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import linededup
from corvane.llm.workspace import Workspace

from .common import BLANKS, LOWER, UPPER, documents, odd_texts, rng, words


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))


def expected(rows):
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            held[k].append(float("-inf") if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        own = float("-inf") if d is None else d
        left = [line for line in lines if len(key(line)) < 20 or len(held[key(line)]) < 3 or max(held[key(line)]) == own]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def corpus():
    r = rng(8)
    shared = [words(r, 6) + f" shared line {i}" for i in range(30)] + ["short", "x" * 19, "y" * 20, "É" * 20 + "abc"]
    rows = []
    for i in range(150):
        lines = [words(r, 8) for _ in range(r.randrange(0, 5))] + r.sample(shared, r.randrange(0, 6))
        if i % 3 == 0:
            lines += ["the very same line that a third of all texts have"] * r.randrange(1, 3)
        r.shuffle(lines)
        rows.append((i, "\n".join(f"{line.upper() if r.random() < 0.3 else line}{r.choice(['', ' ', chr(9)])}" for line in lines)))
    rows += [(500 + i, t) for i, t in enumerate(odd_texts())] + [(600 + i, " padded with a hard blank  ") for i in range(4)]
    rows += [(3, rows[3][1]), (149, rows[149][1]), (None, rows[0][1]), (None, rows[9][1]), (700, "\n".join(f"many different lines {i:09}" for i in range(3000)))]
    return rows


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_plain_counting(spark, batches):
    df = documents(spark, corpus()).withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(0)).withColumn("_left", F.lit("own")).withColumn("_drop_0", F.lit(1))
    got = linededup.dedup_lines(df, batches=batches)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == expected(corpus())
    assert got.columns.count("n_lines") == 1 and {"h1", "_left", "_drop_0"} <= set(got.columns)


def test_runs_are_compacted(spark):
    ws = Workspace(spark, "runs-test")
    runs = linededup.LineRuns(ws, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(100 - 10 * batch - i, 7, i % 2) for i in range(4)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in runs.merged().collect()) == [(7, 0, 10, 100), (7, 1, 10, 99)]


def test_runs_are_joined_as_they_lie(spark):
    """Neither an anti-join with runs nor a merge of runs moves their rows."""
    runs = linededup.LineRuns(Workspace(spark, "runs-test"), fanout=3)
    for batch in range(2):
        runs.add(spark.createDataFrame([(100 - 10 * batch - i, i, batch) for i in range(4)], "doc_id long, h1 long, h2 long"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange" not in runs.merged()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_owners_come_of_the_anti_join(spark, monkeypatch):
    """Without its runs a batch would own lines that larger ids hold."""
    rows = [(i, "one line that every document has, all over\n" + f"and a line of its own, of number {i}") for i in range(40)]
    df = documents(spark, rows)
    told = lambda: sorted((tuple(r) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert told() == expected(rows)
    newest_first, add = linededup.LineRuns._newest_first, linededup.LineRuns.add

    def blind(self, lines):
        with monkeypatch.context() as m:
            m.setattr(linededup.LineRuns, "_newest_first", lambda _: [])
            add(self, lines)

    monkeypatch.setattr(linededup.LineRuns, "add", blind)
    assert told() != expected(rows) and newest_first is linededup.LineRuns._newest_first


def test_many_rows_without_an_id(spark):
    rows = [(None, f"a line that all of these texts hold, number {i % 2}\n{i} is told apart by this line") for i in range(60)] + [(None, None), (5, "x")]
    df = documents(spark, rows)
    assert sorted((tuple(r) for r in linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == expected(rows)


def test_empty(spark):
    df = documents(spark, [(1, "a")])
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    assert [tuple(r) for r in linededup.dedup_lines(documents(spark, [(None, None)])).select("n_lines", "n_dropped", "kept_text").collect()] == [(1, 0, "")]
