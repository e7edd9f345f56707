"""Every registered corpus query on the smallest tables against plain Python: all columns of its contract."""

import hashlib
import os
import zlib

import pyarrow.parquet as pq
import pytest

from corvane.llm import queries, secrets

from . import test_embeddings, test_linededup, test_packing, test_quality, test_secrets, test_simhash, test_warc
from .common import WORD
from .test_mixing import plain_targets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(name, *columns):
    table = pq.read_table(f"{SF}/{name}.parquet").to_pydict()
    return list(zip(*(table[c] for c in columns), strict=True))


def got(spark, name, *columns):
    df = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op1(spark):
    want = test_warc.expected(rows("pages", "page_id", "url", "html"))
    assert got(spark, "op1_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_op2(spark):
    want = [(d, f"{fp:016x}", c) for d, fp, c in test_simhash.expected(rows("documents", "doc_id", "text"))]
    assert got(spark, "op2_simhash", "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_op3(spark):
    found = got(spark, "op3_toxicity", "doc_id", "held_out", "score", "predicted")
    assert sorted(r[0] for r in found) == sorted(d for d, in rows("documents", "doc_id"))
    assert all(h == held_out(d) and 0 <= s <= 1 and p == int(s >= 0.3) for d, h, s, p in found)


def test_op4(spark):
    docs = rows("documents", "doc_id", "source", "text")
    of = {}
    for _, source, text in docs:
        of[source] = of.get(source, 0) + len(WORD.findall(text or ""))
    targets, sums = plain_targets(of), {}
    found = {r[0]: r[1:] for r in got(spark, "op4_mixing", "doc_id", "size", "source_size", "target", "taken")}
    assert len(found) == len(docs)
    for doc_id, source, text in docs:
        size, source_size, target, taken = found[doc_id]
        assert size == len(WORD.findall(text or "")) and source_size == of[source] and abs(target - targets[source]) < 1e-6 and 0 <= taken <= 3 * size
        sums[source] = sums.get(source, 0) + taken
    assert all(abs(sums[s] - targets[s]) <= 3 * queries.mixing.BLOCK_WORDS for s in of)


def test_op5(spark):
    docs = {d: (t, lang) for d, t, lang in rows("documents", "doc_id", "text", "lang")}
    known = {lang for _, lang in docs.values() if lang} | {"und"}
    found = got(spark, "op5_langid", "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r[0] for r in found) == sorted(docs)
    assert all(h == held_out(d) and lang in known and 0 <= s <= 1 and (lang == "und") == (not any(map(str.isalpha, docs[d][0] or ""))) for d, h, lang, s in found)
    judged = [lang == docs[d][1] for d, h, lang, _ in found if h and docs[d][1]]
    assert sum(judged) >= 0.9 * len(judged)


def test_op6(spark):
    found = queries.QUERIES["op6_packing"](spark, SF).collect()
    n = test_packing.check(found, rows("documents", "doc_id", "text"), 2048)
    assert n <= -(-sum(r["length"] for r in found) // 2048) + 2


def test_op7(spark):
    want = [(d, n, gone, hashlib.sha256(left.encode()).hexdigest()) for d, n, gone, left in test_linededup.expected(rows("documents", "doc_id", "text"))]
    assert got(spark, "op7_linededup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)


def test_op8(spark):
    assert got(spark, "op8_embeddings", "vec_id", "n_links", "component_id", "kept") == test_embeddings.expected(rows("embeddings", "vec_id", "embedding"))


def test_op9(spark):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = got(spark, "op9_quality", *columns, "kept")
    assert [r[:7] for r in found] == sorted(((d, *test_quality.plain(t)) for d, t in rows("documents", "doc_id", "text")), key=str)
    assert not any(r[6] and r[7] for r in found)


def test_op10(spark):
    found = {r[0]: r[1:] for r in got(spark, "op10_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc_id, text in rows("documents", "doc_id", "text"):
        base = test_secrets.plain(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = tuple(sum(k == kind for k, _, _ in base) for kind in secrets.BASE_KINDS)
        assert found[doc_id][:4] == (*counts, hashlib.sha256(joined.encode()).hexdigest())
        assert [s for s in found[doc_id][4].split(",") if s and s.split(":")[0] in secrets.BASE_KINDS] == [s for s in joined.split(",") if s]


def test_pipeline(spark):
    df = queries.QUERIES["pipeline"](spark, SF)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and df.count() > 0
