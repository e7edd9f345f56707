"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most three bits differ in at most three bytes, so they share at least
five of the eight.  The index posts each distinct fingerprint under the byte
triples of positions 0-3 and 4-7 (eight postings): five shared positions
always put three into one half, so every wanted pair meets in some list.  The
pairs of a list are tallied over all eight positions, those with fewer than
five shared bytes go, and the rest is verified bit by bit.

Lists longer than ``list_limit`` are not expanded into pairs.  Their
fingerprints are posted again under all 56 five-byte keys; the members of such
a list differ in three bytes only, and one pass over the sorted list links
each member to its component inside the list, with rows in proportion to the
list's length.  No pair is lost either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace

MAX_BITS = 3
MIN_SHARED_BYTES = 5
LIST_LIMIT = 256
TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Signed 64-bit fingerprint of a whole text; zero if it has no word.

    ``bytes.lower`` and ``bytes.split`` work on ASCII alone: A-Z and the white
    space characters 0x20 and 0x09-0x0D.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """Signed number whose bits are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory on very long texts
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _postings(fps: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """A row ``(key, fp)`` for each subset of byte positions; key: subset number, then its bytes."""
    fp, keys = F.col("fp"), []
    for number, subset in enumerate(subsets):
        key = F.lit(number).cast("long")
        for position in subset:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, position))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _tallied_pairs(postings: DataFrame, max_bits: int) -> DataFrame:
    left, right = postings.withColumnRenamed("fp", "u"), postings.withColumnRenamed("fp", "v")
    differing = F.col("u").bitwiseXOR(F.col("v"))
    shared = sum(F.when(_byte(differing, i) == 0, 1).otherwise(0) for i in range(8))
    met = left.join(right, "key").filter("u < v")
    return met.filter(shared >= MIN_SHARED_BYTES).filter(F.bit_count(differing) <= max_bits).select("u", "v")


def _links_inside(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted distinct uint64 values: index of the smallest member reachable by steps of ``max_bits`` or fewer."""
    n, label = len(values), np.arange(len(values))
    if n < 3000:
        near = [np.flatnonzero(np.bitwise_count(values ^ v) <= max_bits) for v in values]
        hits = [(np.repeat(i, len(x)), x) for i, x in enumerate(near)]
        a, b = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        steps = [(a, b)]
    else:  # look each neighbour up: work in proportion to n
        free = np.flatnonzero([(np.bitwise_or.reduce(values ^ values[0]) >> np.uint64(i)) & np.uint64(1) for i in range(64)])
        masks = [sum(1 << int(i) for i in c) for size in range(1, max_bits + 1) for c in combinations(free, size)]
        steps = []
        for mask in masks:
            other = values ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(values, other), n - 1)
            found = np.flatnonzero(values[at] == other)
            if len(found):
                steps.append((found, at[found]))
    while True:
        before = label.copy()
        for a, b in steps:
            np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            return label


def _heavy_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links inside each five-byte list; a list holds at most 2**24 distinct values."""

    def run(batches):
        def links(key_fps):
            values = np.sort(key_fps.view(np.uint64))
            root = values[_links_inside(values, max_bits)]
            moved = root != values
            return values[moved].view(np.int64), root[moved].view(np.int64)

        keys, held = None, []
        for batch in batches:
            k, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            us, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys is not None and k[a] != keys:
                    whole = np.concatenate(held)
                    if len(whole) > 1:
                        u, v = links(whole)
                        us.append(u), vs.append(v)
                    held = []
                keys = k[a]
                held.append(f[a:b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
        if held and len(whole := np.concatenate(held)) > 1:
            u, v = links(whole)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _postings(fps, FIVES).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def _fingerprint_links(ws: Workspace, classes: DataFrame, max_bits: int, list_limit: int) -> DataFrame:
    """``(u, v)`` links between the distinct fingerprints ``fp`` of ``classes``: all pairs of the short lists, spanning ones of longer lists."""
    posted = _postings(classes, TRIPLES)
    lists = ws.save(posted.groupBy("key").count().filter("count > 1"), "posting-lists")
    short = posted.join(lists.filter(F.col("count") <= list_limit).select("key"), "key", "left_semi")
    links = _tallied_pairs(short, max_bits)
    longer = lists.filter(F.col("count") > list_limit).select("key")
    if not longer.isEmpty():
        crowded = posted.join(longer, "key", "left_semi").select("fp").distinct()
        links = links.unionByName(_heavy_links(crowded, max_bits))
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the component of every row.

    Rows: one per row of ``docs``, repeated ids included; they share a
    component if their fingerprints do.  A null or wordless text has
    fingerprint zero and is linked like any other.  A null id is never the
    smallest of a component unless all ids are null.  Empty input gives no
    rows; other columns are not read.  Equal fingerprints are one node, so
    exact copies never make pairs.  ``max_bits`` is at most 3, which the
    five-byte guarantee rests on.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("five shared bytes are guaranteed up to 3 differing bits only")
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(ws, _fingerprint_links(ws, classes, max_bits, list_limit)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


BANDS, BAND_ROWS = 24, 5  # a pair at Jaccard 0.8 shares no band with probability 7e-5
JACCARD_PERCENT = 80
SHINGLE_WORDS = 5
PAIR_LIMIT = 32  # longer band lists are linked through pivots first
BLOCK_SHINGLES = 1 << 16  # of one block of such a list's group
_A, _B = np.random.default_rng(11).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a short text is one shingle, a wordless one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def _bands(shingles: np.ndarray) -> list[int]:
    """One signed key a band: its number and its minhashes, hashed."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory on very long texts
        x = shingles[at : at + 4096, None]
        y = (x ^ _B) * _A
        least = np.minimum(least, ((y ^ (y >> np.uint64(29))) * _A).min(axis=0))
    parts = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(p.tobytes(), i) - 2**63 for i, p in enumerate(parts)]


def _signed(docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """``(row, node, fp, n, bands)``; rows with equal shingle sets are one node, of ``n`` shingles and fingerprint ``fp``."""
    kind = docs.schema[row_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), 7) - 2**63 for s in sets]
                fps = pa.array(map(_majority, sets), pa.int64())
                columns = [part.column(0), pa.array(nodes, pa.int64()), fps, pa.array(map(len, sets), pa.int64()), pa.array([_bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "node", "fp", "n", "bands"])

    return docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"row {kind}, node long, fp long, n long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``(node, shingles)`` from ``(node, text)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _links_across(comers: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of ``comers`` to ``members`` (node, root, shingles) of other components, one for each component that they join.

    The comers' shingles are an inverted index; each member looks its own up
    and so counts what it shares with all comers at once.
    """
    size = comers["shingles"].map(len).to_numpy()
    flat, of = np.concatenate(comers["shingles"].to_list()), np.repeat(np.arange(len(comers)), size)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    nodes, parent, out = comers["node"].to_numpy(), {}, []

    def top(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    roots = comers["root"].to_numpy()
    for node, root, own in members.itertuples(index=False):
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        runs = hi[hit] - lo[hit]
        at = np.repeat(lo[hit] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        shared = np.bincount(of[at], minlength=len(size))
        for i in np.flatnonzero(shared * (100 + percent) >= (size + len(own)) * percent):
            a, b = top(roots[i]), top(root)
            if a != b:
                parent[a] = b
                out.append((min(nodes[i], node), max(nodes[i], node)))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _linked_in_blocks(ws: Workspace, grouped: DataFrame, sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links between different components inside each hub's group; ``grouped``: (hub, node, n, root).

    Who is not of the hub's own component meets everyone of the group.  Both
    sides are cut into blocks of about ``block_shingles`` shingles; a task holds
    one block of either and gives back only links that join components.
    """
    grouped = ws.save(grouped, "grouped")
    comer = F.col("root") != F.col("hub")
    blocks = lambda n: F.ceil(F.sum(n) / F.lit(block_shingles)).cast("int")
    cuts = grouped.groupBy("hub").agg(blocks(F.when(comer, F.col("n")).otherwise(0)).alias("s"), blocks(F.col("n")).alias("m")).filter("s > 0")
    dealt = grouped.join(cuts, "hub").join(sets, "node")
    own = lambda parts: F.pmod(F.xxhash64("node", F.lit(parts)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    comers = dealt.filter(comer).select("hub", own("s").alias("s"), every("m").alias("m"), "node", "root", "shingles")
    members = dealt.select("hub", every("s").alias("s"), own("m").alias("m"), "node", "root", "shingles")
    members = members.toDF("hub_", "s_", "m_", "node_", "root_", "shingles_")

    def run(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        return _links_across(left, right[["node_", "root_", "shingles_"]], percent)

    return comers.groupBy("hub", "s", "m").cogroup(members.groupBy("hub_", "s_", "m_")).applyInPandas(run, "u long, v long")


def _close_pairs(ws: Workspace, nodes: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(u, v, nu, nv)``: pairs of nodes whose fingerprints are linked, through the first node of each fingerprint."""
    known = nodes.filter("n > 0")
    firsts = ws.save(known.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "fingerprints")
    linked = _fingerprint_links(ws, firsts, max_bits, list_limit).distinct()
    a, b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "uv")
    across = linked.join(a, "u").join(b, "v").select(F.col("first_u").alias("a"), F.col("first_v").alias("b"))
    equal = known.join(firsts, "fp").filter("node <> first.node").select(F.struct("node", "n").alias("a"), F.col("first").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return across.union(equal).select(low["node"].alias("u"), high["node"].alias("v"), low["n"].alias("nu"), high["n"].alias("nv"))


def near_copies(
    docs: DataFrame, row_col: str, text_col: str = "text", percent: int = JACCARD_PERCENT, pair_limit: int = PAIR_LIMIT, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """``(row, component)`` for every row of ``docs``: components of five-word shingle Jaccard ``percent`` or more.

    ``row_col`` tells rows of different texts apart; it is read more than once, and so must
    not hang on how the table is scanned.  SimHash comes first: fingerprints of the shingle sets, the
    inverted index of their bytes, the count of shared bytes and the differing bits, as in
    ``near_duplicates``; its pairs are verified by whole shingle sets and join close copies.
    Pairs at the border differ in about ten bits, which that index can't reach, so texts of
    different components go on to minhash lists.  Candidates there share one of ``BANDS`` minhash bands; each candidate pair
    is verified by its whole shingle sets.  Lists up to ``pair_limit`` nodes give
    all their pairs.  In a longer one every node meets two pivots of the list,
    twice; the lists that then still hold several components are compared in blocks,
    by the component that most of a list belongs to, all that are not of it
    against everyone.  So no list is expanded into its pairs, and only pairs
    without a common band are lost.  Null and wordless texts are alike.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near-copies")
    signed = ws.save(_signed(docs, row_col, text_col), "signed")
    nodes = ws.save(signed.groupBy("node").agg(F.min("row").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min_by("bands", "row").alias("bands")), "nodes")
    close = ws.save(_close_pairs(ws, nodes.select("node", "fp", "n")), "close")
    posted = nodes.select("node", "n", F.explode("bands").alias("key"))
    lists = ws.save(posted.groupBy("key").count().filter("count > 1"), "lists")
    shared = ws.save(posted.join(lists, "key"), "shared")
    texts = docs.select(F.col(row_col).alias("first"), F.col(text_col).cast("string").alias("text"))
    wanted = shared.select("node").union(close.select("u")).union(close.select("v")).distinct()
    listed = nodes.join(wanted, "node", "left_semi")
    sets = ws.save(_sets(listed.select("node", "first").join(texts, "first").dropDuplicates(["node"])), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        near_in_size = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
        wanted = pairs.filter(near_in_size).select("u", "v").distinct()
        both = wanted.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(
            sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"
        )
        met = F.size(F.array_intersect("a", "b"))
        return both.filter(met * (100 + percent) >= (F.size("a") + F.size("b")) * percent).select("u", "v")

    def rooted(of: DataFrame, own: Workspace) -> DataFrame:
        roots = connected_components(own, links)
        return of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = ws.save(verified(close), "links-close")
    short = ws.save(rooted(shared.filter(F.col("count") <= pair_limit), ws), "short")
    left, right = (short.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "uv")
    links = links.unionByName(ws.save(verified(left.join(right, "key").filter("u < v and ru <> rv")), "links-short"))
    long = shared.filter(F.col("count") > pair_limit)
    if not long.isEmpty():
        for turn in range(2):
            members = ws.save(rooted(long, ws), f"members-{turn}")
            order = F.col("node").bitwiseXOR(F.xxhash64("key", F.lit(turn)))
            ends = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(order).alias("a"), F.max(order).alias("b")).filter("lo <> hi")
            drawn = F.transform(F.array("a", "b"), lambda end: end.bitwiseXOR(F.xxhash64("key", F.lit(turn))))
            pivots = ends.select("key", F.explode(F.array_distinct(drawn)).alias("pivot"))
            known = members.select("key", F.col("node").alias("pivot"), F.col("n").alias("nv"), F.col("root").alias("other"))
            met = members.join(pivots.join(known, ["key", "pivot"]), "key").filter("root <> other")
            found = ws.save(verified(met.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"), F.col("n").alias("nu"), "nv")), f"links-{turn}")
            links = links.unionByName(found)
        members = ws.save(rooted(long, ws), "members")
        held = members.groupBy("key", "root").count()
        hubs = held.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("hub"), F.count("*").alias("roots")).filter("roots > 1")
        grouped = members.join(hubs.select("key", "hub"), "key").select("hub", "node", "n", "root").distinct()
        links = links.unionByName(ws.save(_linked_in_blocks(ws, grouped, sets, percent, block_shingles), "links"))
    last = Workspace(spark, "near-copies")
    found = last.save(signed.select("row", "node"), "rows")
    out = rooted(found, last).select("row", F.col("root").alias("component"))
    ws.drop_all()
    return out
