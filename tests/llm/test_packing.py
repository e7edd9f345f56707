"""Tokens, pieces and bins."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import packing
from corvane.llm.queries import tokenizer_path

from .common import documents, odd_texts, rng, words

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "The cat's  toy", " lead", "trail ", "a\n b", "a \n b", "a\n  b", "tab\t x", "x <|endoftext|> y", "don't we'll I'd", "  x", "x  y", "a\x00b c", "12 345  678", "\r\n \r\n", "Größe über ñandú", "x\n", "x\n\n y",
    "日本語 テキスト", "\U0001f600 \U0001f600\U0001f600",
]


def test_ids_are_the_tokenizers():
    r = rng(6)
    texts = TEXTS + [t or "" for t in odd_texts()] + [words(r, 300) for _ in range(20)]
    for _ in range(2):  # the second time from remembered chunks
        got = packing.encode_texts(texts, tokenizer_path())
        assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [plain_ids(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .,'\n\t  4é\U0001f600s<|>"), max_size=30), max_size=5))
def test_ids_of_any_text(texts):
    got = packing.encode_texts(texts, tokenizer_path())
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [plain_ids(t) for t in texts]


def check(got, rows, most):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    for doc_id, text in rows:
        ids = [*plain_ids(text), packing.END_ID]
        pieces = sorted(docs[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // most) and all(r["length"] == most for r in pieces[1:])
        for r in pieces:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(own) == r["ids_crc32"]
    return len(bins)


def test_pack(spark):
    r = rng(7)
    rows = [(i, words(r, r.choice([1, 5, 20, 60]))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(odd_texts() + TEXTS)] + [(5000 + i, "hot copy " * 9) for i in range(100)]
    df = documents(spark, rows).withColumn("offset", F.lit("clash")).withColumn("length", F.lit(0))
    got = packing.pack_documents(df, tokenizer_path(), sequence_tokens=128).collect()
    n = check(got, rows, 128)
    assert n <= 1.02 * sum(r["length"] for r in got) / 128 + 1


def test_ids_can_be_kept(spark):
    df = documents(spark, [(1, "some words " * 40), (None, "x"), (2, "x"), (2, "x")])
    got = packing.pack_documents(df, tokenizer_path(), 64, with_ids=True).collect()
    assert sum(r["doc_id"] == 2 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    own = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert sum((r["ids"] for r in own), []) == [*plain_ids("some words " * 40), 0]
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_histogram(seed):
    r = rng(seed)
    counts = {}
    for _ in range(3000):
        length = min(100, 1 + int(r.expovariate(0.05)))
        counts[length] = counts.get(length, 0) + 1
    used, bins = defaultdict(int), 0
    for times, lengths in packing.pack_histogram(counts, 100):
        assert sum(lengths) <= 100
        bins += times
        for length in lengths:
            used[length] += times
    assert used == counts and bins <= sum(k * n for k, n in counts.items()) / 100 + 2


def test_best_two_fit_beats_greedy():
    # greedy takes 6 and leaves 4; two of 5 replace nothing, but 6 gives way to 5 and 5
    assert sorted(packing.pack_histogram({6: 1, 5: 2}, 10), key=lambda p: p[1]) == [(1, [5, 5]), (1, [6])]
    assert packing.pack_histogram({}, 10) == []


def test_cut_lengths():
    assert packing.cut_lengths(5, 4) == [1, 4] and packing.cut_lengths(8, 4) == [4, 4] and packing.cut_lengths(3, 4) == [3]
