"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Only lengths decide how documents pack, and lengths are at most
``sequence_tokens``.  So the packer runs once on the histogram of lengths (at
most 2048 counts, whatever the corpus holds): it fills a bin greedily with the
largest length that fits, then replaces the bin's smallest document by two
unpacked ones that fit its expanded gap more tightly, and repeats the finished
bin as often as the counts allow.  The outcome is a short list of bin patterns.

Documents then find their places by rank: all pieces of a length are numbered
by two-level prefix sums over hash buckets, and a piece's number among its
length says which repetition of which pattern it belongs to.  That is one join
with the pattern table; no task packs, or even sees, a whole length.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace

SEQUENCE_TOKENS = 2048
END_ID = 0
CACHED_CHUNKS = 500_000  # chunks whose ids a worker keeps
SPECIAL = "<|endoftext|>"
#: Fixed value: how the byte-level vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Encoder:
    """A worker's byte-pair encoder for a vocabulary file, with remembered chunks.

    Files of this kind number their tokens in merging order, so the ids are
    ranks; ``tests/llm`` holds the results against the tokenizer's own.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        as_byte = _byte_characters()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token != SPECIAL}
        self.fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}

    def text(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that each start with a blank and a visible character, encoded end to end."""
        if not chunks:
            return []
        ids = np.asarray(self.fast.encode_ordinary("".join(chunks)), dtype="<u4")
        ends = np.cumsum(self.token_bytes[ids])
        stops = np.cumsum(list(map(len, map(str.encode, chunks))))
        at = np.searchsorted(ends, stops)
        if not (ends[np.minimum(at, len(ends) - 1)] == stops).all():
            raise AssertionError("a token spans two chunks")
        raw, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode_texts(texts: list[str], tokenizer_file: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The pre-tokenizer never joins a blank to the character before it, so a
    text may be cut before any blank that another character follows, and its
    chunks encoded on their own.  Chunks repeat, and a worker remembers their
    ids.  Texts with a blank before white space, or with a special token, are
    encoded whole.
    """
    encoder, out, split = _encoder(tokenizer_file), [b""] * len(texts), {}
    known = encoder.known
    for n, text in enumerate(texts):
        if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or "\0" in text or SPECIAL in text:
            out[n] = encoder.text(text)
        else:
            split[n] = text.replace(" ", "\0 ").split("\0")
            out[n] = encoder.text(split[n].pop(0))
    missing = set(filterfalse(known.__contains__, chain.from_iterable(split.values())))
    if odd := {c for c in missing if c[1].isspace()}:
        for n in [n for n, chunks in split.items() if not odd.isdisjoint(chunks)]:
            out[n] = encoder.text(texts[n])
            del split[n]
        missing -= odd
    new = list(missing)
    known.update(zip(new, encoder.chunks(new), strict=True))
    for n, chunks in split.items():
        out[n] += b"".join(map(known.__getitem__, chunks))
    if len(known) > CACHED_CHUNKS:
        for chunk in new:
            del known[chunk]
    return out


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: full ones, before them a shorter first one if need be."""
    return [n % most] * (n % most > 0) + [most] * (n // most)


def token_pieces(docs: DataFrame, tokenizer_file: str, sequence_tokens: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """``(_row, doc_id, piece, start, length, ids_crc32[, ids])`` for each piece of each row; a null text is empty."""
    schema = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a bounded number of texts in memory
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                rows: list[list] = [[] for _ in range(7)]
                for row, doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode_texts(texts, tokenizer_file), strict=True):
                    raw += END_ID.to_bytes(4, "little")
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(raw) // 4, sequence_tokens)):
                        own = raw[4 * start : 4 * (start + length)]
                        ids = np.frombuffer(own, dtype="<i4") if with_ids else None
                        for column, value in zip(rows, (row, doc, piece, start, length, zlib.crc32(own), ids), strict=True):
                            column.append(value)
                        start += length
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 + with_ids]
                names = ["_row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], most: int) -> list[tuple[int, list[int]]]:
    """Bin patterns ``(repetitions, lengths)`` that use up ``counts`` of lengths 1..most.

    Each step makes one bin: greedy filling by the largest length that fits,
    then best-two-fit replacement of the smallest while the gap shrinks.
    """
    left = np.zeros(most + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while left.any():
        lengths, gap = [], most
        while gap and len(fitting := np.flatnonzero(left[: gap + 1])):
            length = int(fitting[-1])
            n = min(int(left[length]), gap // length)
            lengths += [length] * n
            left[length] -= n
            gap -= n * length
        while gap and len(lengths) > 1:
            small = lengths[-1] if lengths[-1] <= min(lengths) else min(lengths)
            room = gap + small
            free = np.flatnonzero(left[: room + 1])
            if not len(free):
                break
            # for each first document the largest second one beside it
            at = np.searchsorted(free, room - free, side="right") - 1
            second = np.where(at >= 0, free[np.maximum(at, 0)], 0)
            same = (second == free) & (left[free] < 2)
            second = np.where(same, np.where(at >= 1, free[np.maximum(at - 1, 0)], 0), second)
            both = np.where(second > 0, free + second, 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            lengths.remove(small)
            left[small] += 1
            for new in (int(free[best]), int(second[best])):
                lengths.append(new)
                left[new] -= 1
            gap = room - int(both[best])
        kinds, used = np.unique(lengths, return_counts=True)
        again = int((left[kinds] // used).min())
        left[kinds] -= again * used
        patterns.append((again + 1, sorted(lengths, reverse=True)))
    return patterns


def place(ws: Workspace, pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``pieces`` is a saved table with ``_row``, ``piece`` and ``length``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most sequence_tokens rows
    rows, first_bin, used = [], 0, dict.fromkeys(histogram, 0)
    for times, lengths in pack_histogram(histogram, sequence_tokens):
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rows.append((length, used[length], used[length] + times * each, each, first_bin, offset))
            used[length] += times * each
            offset += each * length
        first_bin += times
    # patterns x lengths in a pattern: bounded by sequence_tokens, not by the corpus
    by_length: dict[int, list] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(tuple(rest))
    spans = "length long, spans array<struct<from_rank:long,to_rank:long,each:long,first_bin:long,at:long>>"
    table = spark.createDataFrame(list(by_length.items()), spans)

    n_buckets = max(1, math.ceil(math.sqrt(sum(histogram.values())) / 4))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(n_buckets)).cast("int"))
    sums = keyed.groupBy("length", "bucket").count()
    starts = sums.select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("_row", "piece")) - 1
    ranked = keyed.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside"))
    found = ranked.join(F.broadcast(table), "length")  # at most sequence_tokens rows
    own = F.filter("spans", lambda s: (s["from_rank"] <= F.col("rank")) & (F.col("rank") < s["to_rank"]))
    found = found.withColumn("span", F.element_at(own, 1)).withColumn("nth", F.col("rank") - F.col("span.from_rank"))
    found = found.withColumn("sequence_id", F.col("span.first_bin") + F.expr("nth div span.each"))
    found = found.withColumn("offset", F.col("span.at") + F.expr("nth % span.each") * F.col("length"))
    return found.drop("bucket", "inside", "ahead", "rank", "spans", "span", "nth")


def pack_documents(docs: DataFrame, tokenizer_file: str, sequence_tokens: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` for each piece of each row.

    A document is its text's ids and the end id, so that a null or empty text
    is one token.  Only documents longer than a sequence are cut.  Repeated
    rows are packed one by one, null ids stay null, other columns are not
    read, and an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "pack")
    pieces = ws.save(token_pieces(docs, tokenizer_file, sequence_tokens, with_ids), "pieces")
    return place(ws, pieces, sequence_tokens).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
