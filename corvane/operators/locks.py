"""Analyses of lock and page-access logs.

What a lock manager or a page cache decides step by step is a property of its
log: who waits for whom is a join, the mode of an item an aggregate, deadlock
a closed path in the waits-for graph, and the two queues of a cache that has
evicted nothing an aggregate of accesses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lock_modes(held: DataFrame) -> DataFrame:
    """``(item, mode, holders)`` from locks held now (item, txn, mode): Exclusive if any is, else Shared."""
    exclusive = F.max(F.when(F.col("mode") == "Exclusive", 1).otherwise(0)) == 1
    mode = F.when(exclusive, F.lit("Exclusive")).otherwise(F.lit("Shared"))
    return held.groupBy("item").agg(mode.alias("mode"), F.count_distinct("txn").alias("holders"))


HELD_ROWS = 1 << 21  # of a block of owners, which a task holds
WANTED_ROWS = 1 << 20  # of a block of waiters, which it holds besides
WAITER_BLOCKS = 16  # at least, so that a few owners' locks keep several tasks busy
MARKS = 1 << 20  # edges that a task hands on at a time
MOST_TASKS = 1 << 14  # that pairs of blocks are dealt to


def _packed(batches: Iterator[pa.RecordBatch], first: str) -> Iterator[pa.RecordBatch]:
    """The rows of a part as one row, which holds them sorted in Arrow's stream format."""
    rows = pa.Table.from_batches([*batches] or [pa.record_batch({})])
    if not rows.num_rows:
        return
    rows = rows.sort_by([(first, "ascending"), ("exclusive", "descending")]).combine_chunks().to_batches()[0]
    columns = [rows.column("txn").dictionary_encode(), rows.column("item").dictionary_encode(), rows.column("exclusive").cast(pa.bool_())]
    rows, sink = pa.RecordBatch.from_arrays(columns, names=["txn", "item", "exclusive"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    part = pa.array([TaskContext.get().partitionId()], pa.int32())
    yield pa.RecordBatch.from_arrays([part, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "block"])


def _edges_of(wanted: pa.RecordBatch, held: pa.RecordBatch, marks: int) -> Iterator[pa.RecordBatch]:
    """Rows of a waiter and the owners that it waits for, from requests sorted by waiter and locks sorted by item, exclusive ones first."""
    waiters, owners, items = wanted["txn"].dictionary, held["txn"].dictionary, held["item"].dictionary
    owner, n = held["txn"].indices.to_numpy().astype(np.int64), len(owners)
    starts = np.searchsorted(held["item"].indices.to_numpy(), np.arange(len(items) + 1))
    strong = starts[:-1] + np.add.reduceat(held["exclusive"].to_numpy(zero_copy_only=False).astype(np.int64), starts[:-1])
    code = pc.index_in(wanted["item"].dictionary, items).fill_null(-1).to_numpy()[wanted["item"].indices.to_numpy()]
    own = pc.index_in(waiters, owners).fill_null(-1).to_pylist()
    ends = np.where(wanted["exclusive"].to_numpy(zero_copy_only=False), starts[code + 1], strong[code])
    meets = np.flatnonzero((code >= 0) & (ends > starts[code]))
    lo, hi = starts[code[meets]], ends[meets]
    cuts = np.searchsorted(wanted["txn"].indices.to_numpy()[meets], np.arange(len(waiters) + 1))
    sums = np.concatenate([[0], np.cumsum(hi - lo)])[cuts].tolist()
    lo, hi, cuts, at, found, most = lo.tolist(), hi.tolist(), cuts.tolist(), [], [], 0
    for w in range(len(waiters)):
        spans = [owner[lo[i] : hi[i]] for i in range(cuts[w], cuts[w + 1])]
        if not spans:
            continue
        if 8 * (sums[w + 1] - sums[w]) < n:
            met = np.unique(np.concatenate(spans))
        else:
            marked = np.zeros(n, dtype=bool)
            for span in spans:
                marked[span] = True
            met = np.flatnonzero(marked)
        met = met[met != own[w]]
        at.append(w)
        found.append(met)
        most += len(met)
        if most >= marks:
            yield _listed(waiters, owners, at, found)
            at, found, most = [], [], 0
    if at:
        yield _listed(waiters, owners, at, found)


def _listed(waiters: pa.Array, owners: pa.Array, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(met) for met in found])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), owners.take(pa.array(np.concatenate(found))))
    return pa.RecordBatch.from_arrays([waiters.take(pa.array(at)), lists], names=["waiter", "owners"])


def _edges_of_cells(batches: Iterator[pa.RecordBatch], marks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pair in zip(*batch.columns, strict=True):
            yield from _edges_of(*(pa.ipc.open_stream(block.as_buffer()).read_next_batch() for block in pair), marks)


def waits_for(requests: DataFrame, held: DataFrame, held_rows: int = HELD_ROWS, marks: int = MARKS) -> DataFrame:
    """``(waiter, owner)``: a request waits for every other holder unless both are shared.

    Repeated locks and requests of an item are one, in the strongest mode, before they meet.
    Waiters and owners are cut into blocks by hash, and each block of waiters meets each
    block of owners in one task, so that an edge is found in one place however many
    items give it, and no edge is shuffled or written to be told from its repeats.  Nor is a
    lock or request written once for each block that it meets: a block is one packed row,
    shuffled once and read again by each of its tasks.  There are as many blocks of owners as
    ``held_rows`` locks each make.  Locks and requests are counted when the plan is built.
    """
    exclusive = F.max(F.when(F.col("mode") == "Shared", 0).otherwise(1)).alias("exclusive")
    kinds = requests.select("item", "txn").union(held.select("item", "txn")).schema

    def blocks(df: DataFrame, rows: int, least: int, first: str, name: str) -> DataFrame:
        known = df.filter("item is not null and txn is not null").select(*(F.col(k.name).cast(k.dataType) for k in kinds), "mode")
        parts = max(least, -(-known.count() // rows))
        locks = known.repartition(parts, "txn").groupBy("item", "txn").agg(exclusive)
        packed = locks.mapInArrow(lambda batches: _packed(batches, first), "part int, block binary")
        return packed.repartitionById(parts, "part").select(F.col("block").alias(name))

    wanted, owned = blocks(requests, WANTED_ROWS, WAITER_BLOCKS, "txn", "wanted"), blocks(held, held_rows, 1, "item", "held")
    cells = wanted.crossJoin(owned.hint("shuffle_replicate_nl")).coalesce(MOST_TASKS)
    kind = kinds["txn"].dataType.simpleString()
    edges = cells.mapInArrow(lambda batches: _edges_of_cells(batches, marks), f"waiter {kind}, owners array<{kind}>")
    return edges.select("waiter", F.explode("owners").alias("owner"))


def _components(edges: DataFrame) -> DataFrame | None:
    """``(txn, component)`` of strongly connected components, from ``(waiter, owner)``; transactions that are left out are alone, all are if None.

    Each turn the largest of a random order's ranks travels along the edges; who
    has the same one and reaches its holder is in the holder's component.
    Others go on with the edges between equal ranks.  A turn takes as many
    joins as the longest way that a rank travels.
    """
    left, found, turn = edges.filter("waiter <> owner").distinct().checkpoint(), None, 0
    while True:
        waiters, owners = left.select(F.col("waiter").alias("owner")).distinct(), left.select(F.col("owner").alias("waiter")).distinct()
        left = left.join(waiters, "owner", "left_semi").join(owners, "waiter", "left_semi").select("waiter", "owner").checkpoint()
        if left.isEmpty():
            return found
        ranks = left.select(F.col("waiter").alias("txn")).union(left.select("owner")).distinct()
        ranks = ranks.select("txn", F.struct(F.xxhash64("txn", F.lit(turn)).alias("h"), F.col("txn").alias("t")).alias("rank")).checkpoint()
        while True:
            came = left.join(ranks.withColumnRenamed("txn", "waiter"), "waiter").groupBy(F.col("owner").alias("txn")).agg(F.max("rank").alias("came"))
            after = ranks.join(came, "txn", "left").select("txn", F.greatest("rank", "came").alias("rank"), (F.col("came") > F.col("rank")).alias("moved")).checkpoint()
            ranks = after.select("txn", "rank")
            if after.filter("moved").isEmpty():
                break
        own = left.join(ranks.select(F.col("txn").alias("waiter"), F.col("rank").alias("r")), "waiter").join(ranks.select(F.col("txn").alias("owner"), "rank"), "owner")
        left = own.filter("r = rank").select("waiter", "owner").checkpoint()
        reach = front = ranks.filter("txn = rank.t").select("txn").checkpoint()
        while not front.isEmpty():
            back = left.join(front.withColumnRenamed("txn", "owner"), "owner", "left_semi").select(F.col("waiter").alias("txn")).distinct()
            front = back.join(reach, "txn", "left_anti").checkpoint()
            reach = reach.union(front).checkpoint()
        piece = ranks.join(reach, "txn", "left_semi").select("txn", F.col("rank.t").alias("component")).checkpoint()
        found, turn = piece if found is None else found.union(piece), turn + 1
        left = without_transactions(left, reach)


def deadlocked(edges: DataFrame) -> DataFrame:
    """``(txn)`` of transactions that wait, through others, for themselves.

    Transactions that wait for one other only are followed by pointer doubling:
    a ring or an open chain of any length takes a logarithmic number of joins
    with tables as long as the chain.  Only those that wait for several, with
    chains between them taken as edges, go through ``_components``; a chain is
    on a cycle from the first place where such an edge of one component enters.
    The session must have a checkpoint folder.
    """
    edges = edges.select("waiter", "owner").filter("waiter is not null and owner is not null").distinct().checkpoint()
    alone = edges.filter("waiter = owner").select(F.col("waiter").alias("txn"))
    between = edges.filter("waiter <> owner")
    degree = between.groupBy("waiter").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).checkpoint()
    jump = degree.filter("n = 1").select(F.col("waiter").alias("txn"), F.col("owner").alias("to")).checkpoint()
    jumps, single = [jump], jump.select("txn")
    for turn in range(jump.count().bit_length()):  # then every jump is longer than any chain
        onward = jump.select(F.col("txn").alias("to"), F.col("to").alias("further"))
        jump = jump.join(onward, "to", "left").select("txn", F.coalesce("further", "to").alias("to"))
        jump = jump.checkpoint() if turn % 2 else jump
        jumps.append(jump)
    jump = jump.checkpoint()
    rings = jump.select(F.col("to").alias("txn")).distinct().join(single, "txn", "left_semi")
    several = degree.filter("n > 1").select("waiter")
    ways = between.join(several, "waiter", "left_semi").join(jump.withColumnRenamed("txn", "owner"), "owner", "left")
    ways = ways.select("waiter", "owner", F.coalesce("to", "owner").alias("end")).join(several.withColumnRenamed("waiter", "end"), "end", "left_semi").checkpoint()
    if ways.isEmpty():
        return rings.union(alone).distinct()
    parts = _components(ways.select("waiter", F.col("end").alias("owner")))
    if parts is None:
        inside = ways.filter("waiter = end")
    else:
        ends = ways.join(parts.select(F.col("txn").alias("waiter"), F.col("component").alias("a")), "waiter", "left")
        inside = ends.join(parts.select(F.col("txn").alias("end"), F.col("component").alias("b")), "end", "left").filter("waiter = end or a = b")
    marked = inside.select(F.explode(F.array("waiter", "owner", "end")).alias("txn")).distinct().checkpoint()
    for jump in jumps:  # on along the chains
        marked = marked.union(jump.join(marked, "txn", "left_semi").select(F.col("to").alias("txn"))).distinct().checkpoint()
    return rings.union(alone).union(marked).distinct()


def waits_for_without(requests: DataFrame, held: DataFrame, gone: DataFrame) -> DataFrame:
    """The waits-for graph without the transactions in ``gone`` (txn), which are left out of the logs before any edge is made."""
    out = gone.select("txn").distinct()
    return waits_for(requests.join(out, "txn", "left_anti"), held.join(out, "txn", "left_anti"))


def without_transactions(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the transactions in ``gone`` (txn): no edge from or to them."""
    left = edges.join(gone.select(F.col("txn").alias("waiter")), "waiter", "left_anti")
    return left.join(gone.select(F.col("txn").alias("owner")), "owner", "left_anti").select("waiter", "owner")


def cache_queues(accesses: DataFrame) -> DataFrame:
    """``(pool, page, queue, at, uses)`` for pools that never filled up, from accesses (pool, seq, page).

    A page used once is in the first-in queue since then; used again it is in
    the recency queue since its last use.
    """
    uses = accesses.groupBy("pool", "page").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("uses"))
    again = F.col("uses") > 1
    return uses.select(
        "pool", "page", F.when(again, F.lit("lru")).otherwise(F.lit("fifo")).alias("queue"), F.when(again, F.col("last")).otherwise(F.col("first")).alias("at"), "uses"
    )
