"""Mixing sources to target weights, as slots over fixed-length blocks of words.

Each source's documents are laid end to end (in a pseudorandom but fixed
order) and cut into blocks of ``block_words`` words.  The mix is a row of
slots, dealt into output shards of ``shard_slots``.

1. Every shard draws its source counts: each slot of a shard draws a source with
   the targets' probabilities, and the counts of a shard are a multinomial.
2. A source's slots are numbered through the shards by prefix sums, so that a
   shard holds one range of a source's numbers; a permutation of the source
   deals these numbers out.
3. The drawn totals differ from the targets by about the root of the number of
   slots.  The slots that a source drew in excess, chosen by its permutation,
   pass to the sources that drew too few, one for one, and stay in their shard.
   Totals then are the targets, to a block.
4. A second permutation of the source maps the numbers to indexes of its blocks,
   over all that the source drew (at most ``max_epochs`` of its length), and
   a third one each epoch.  Slots and blocks meet in one join by (source, block).

All of it is arithmetic on indexes, so a rerun gives the same mix; another
``seed`` is another draw, with other blocks taken.

Offsets inside a source, and a source's slot numbers, are two-level prefix sums,
and so no task sees a whole source, even if one holds a third of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import WS, let
from .workspace import Workspace, own_names

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
ROUNDS = 10
SLOT_RUN = 65_536  # slots that one task makes
SHARD_RUN = 4096  # shards that one window adds up
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, salt: Column) -> Column:
    """A pseudorandom bijection of 0..n-1 for each salt.

    Each round pairs every index with another by a reflection, and a hash of
    the pair decides whether the two change places.
    """

    def swap(given):
        def turned(x, turn):
            other = F.pmod(F.pmod(F.xxhash64(given["salt"], turn), given["n"]) - x, given["n"])
            return F.when(F.xxhash64(F.greatest(x, other), turn, given["salt"]) % 2 == 0, x).otherwise(other)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), given["index"], turned)

    return let(F.struct(index.alias("index"), n.alias("n"), salt.alias("salt")), swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` from ``(source, source_size)``, one row a source.

    Weights repeat along the sources by code point, null last.  A target stops
    at ``max_epochs`` times its source's size.  In the order of cap over
    weight, the first source whose cap is not below its share fixes the level
    that this and all later ones share by weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("cap", (max_epochs * F.col("source_size")).cast("long")).withColumn("fill", F.col("cap") / F.col("weight"))
    everyone = W.partitionBy()
    earlier = W.orderBy("fill", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    sharing = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = ranked.withColumn("level", left / sharing)
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("fill", "rank", "level"))
    fixed = levels.withColumn("fixed", F.min(fits).over(everyone)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap").cast("double")))
    return fixed.select("source", "source_size", F.col("rank").cast("int").alias("rank"), "weight", target.alias("target"))


def _plan(ws: Workspace, targets: DataFrame, block_words: int) -> DataFrame:
    """``(rank, n_blocks, n_slots, first)`` of the sources that have words: how many slots of the mix are theirs, and how many come before."""
    plan = targets.filter("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    plan = plan.withColumn("n_slots", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")).filter("n_slots > 0")
    first = F.sum("n_slots").over(W.orderBy("rank")) - F.col("n_slots")  # one row a source
    return ws.save(plan.select("rank", "n_blocks", "n_slots", first.alias("first")), "plan")


def draw_counts(plan: DataFrame, all_slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(shard, rank, n)``: how many of a shard's slots each source draws, a multinomial for each shard.

    A slot's draw is a pseudorandom number below ``all_slots``; it is the source
    in whose range of ``first`` and ``n_slots`` it falls.  Ranges are found by an
    equi-join on parts of equal width, about four for each source.
    """
    n_sources = plan.count()
    width = max(1, -(-all_slots // max(4096, 4 * n_sources)))
    parts = F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + n_slots - 1) div {width}"))
    ranges = plan.select("rank", "first", (F.col("first") + F.col("n_slots")).alias("end"), F.explode(parts).alias("part"))
    slots = plan.sparkSession.range(0, all_slots, 1, max(1, -(-all_slots // SLOT_RUN)))
    drawn = slots.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed).cast("long")), F.lit(max(1, all_slots))).alias("draw"))
    met = drawn.withColumn("part", F.expr(f"draw div {width}")).join(ranges, "part").filter("first <= draw and draw < end")
    return met.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def _dealt(ws: Workspace, plan: DataFrame, counts: DataFrame, max_epochs: int, shard_slots: int) -> DataFrame:
    """``(rank, number, shard, slot)`` of every slot, with ``number`` below the source's ``n_slots``, and its ``n_blocks`` and ``span``."""
    run = F.expr(f"shard div {SHARD_RUN}")
    in_runs = counts.groupBy("rank", run.alias("run")).agg(F.sum("n").alias("n"))
    ahead = in_runs.select("rank", "run", (F.sum("n").over(W.partitionBy("rank").orderBy("run")) - F.col("n")).alias("ahead"))
    inside = F.sum("n").over(W.partitionBy("rank", "run").orderBy("shard")) - F.col("n")
    beside = F.sum("n").over(W.partitionBy("shard").orderBy("rank")) - F.col("n")  # one row a source
    in_shard = F.sum("n").over(W.partitionBy("shard"))
    spread = counts.select("*", beside.alias("beside"), in_shard.alias("in_shard"), run.alias("run")).withColumn("inside", inside)
    ranges = spread.join(ahead, ["rank", "run"]).withColumn("start", F.col("ahead") + F.col("inside"))

    totals = plan.join(in_runs.groupBy("rank").agg(F.sum("n").alias("drawn")), "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    totals = totals.withColumn("excess", F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0))).withColumn("lack", F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0)))
    by_rank = W.orderBy("rank")  # one row a source
    totals = totals.withColumn("excess_before", F.sum("excess").over(by_rank) - F.col("excess")).withColumn("lack_before", F.sum("lack").over(by_rank) - F.col("lack"))
    span = F.least(F.greatest("drawn", "n_slots"), F.col("n_blocks") * max_epochs)
    totals = ws.save(totals.withColumn("span", span).drop("first"), "totals")

    n_tasks = max(1, -(-int(totals.agg(F.sum("n_slots")).first()[0] or 0) // SLOT_RUN))
    each = ranges.join(totals.select("rank", "drawn", "n_slots", "excess_before"), "rank").repartition(n_tasks, "shard", "rank")
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    number = permuted(F.col("start") + F.col("i"), F.col("drawn"), F.xxhash64("rank", F.lit("deal")))
    slot = permuted(F.col("beside") + F.col("i"), F.col("in_shard"), F.xxhash64("shard", F.lit("slot")))
    each = each.select("rank", "shard", slot.alias("slot"), number.alias("number"), "n_slots", "excess_before")
    dealt = ws.save(each.select("rank", "shard", "slot", "number", F.when(F.col("number") >= F.col("n_slots"), F.col("excess_before") + F.col("number") - F.col("n_slots")).alias("passed")), "dealt")
    lacking = totals.filter("lack > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)))
    lacking = lacking.select("rank", (F.col("lack_before") + F.col("i")).alias("passed"), (F.col("drawn") + F.col("i")).alias("number"))
    moved = dealt.filter("passed is not null").select("passed", "shard", "slot").join(lacking, "passed")
    columns = ["rank", "number", "shard", "slot"]
    return dealt.filter("passed is null").select(*columns).unionByName(moved.select(*columns)).join(totals.select("rank", "n_blocks", "span"), "rank")


def _slots(ws: Workspace, targets: DataFrame, max_epochs: int, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``(rank, block, epoch, shard, slot)``: one row for each slot of the mix."""
    plan = _plan(ws, targets, block_words)
    all_slots = int(plan.agg(F.sum("n_slots")).first()[0] or 0)
    counts = ws.save(draw_counts(plan, all_slots, shard_slots, seed), "counts")  # a row for each shard and source
    slots = _dealt(ws, plan, counts, max_epochs, shard_slots)
    index = permuted(F.col("number"), F.col("span"), F.xxhash64("rank", F.lit("blocks")))

    def place(at):
        epoch = F.call_function("div", at, F.col("n_blocks")).cast("int")
        block = permuted(F.pmod(at, F.col("n_blocks")), F.col("n_blocks"), F.xxhash64("rank", epoch))
        return F.struct(block.alias("block"), epoch.alias("epoch"))

    slots = slots.select("rank", "shard", "slot", F.inline(F.transform(F.array(index), place)))
    return slots.select("rank", "block", "epoch", "shard", "slot")


def _offsets(ws: Workspace, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``rank``, ``source_size``, ``target`` and ``off``, the words before a document in its source."""
    n_buckets = max(1, math.ceil(math.sqrt(sized.count()) / 4))
    marked = sized.join(targets.drop("weight"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    marked = marked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(n_buckets)))
    sums = marked.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("rank", "bucket", (F.sum("n").over(W.partitionBy("rank").orderBy("bucket")) - F.col("n")).alias("start"))
    inside = F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("doc_id", "_digest", "_row")) - F.col("size")
    placed = marked.withColumn("inside", inside).join(starts, ["rank", "bucket"])
    return ws.save(placed.select("_row", "doc_id", "rank", "size", "source_size", "target", (F.col("start") + F.col("inside")).alias("off")), "placed")


def _pieces(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """``(_row, epoch, shard, slot, first, n)``: the words of a document that a slot takes."""
    spans = placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"off div {block_words}"), F.expr(f"(off + size - 1) div {block_words}")))
    )
    begin = F.greatest(F.col("off"), F.col("block") * block_words)
    end = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = spans.select("_row", "rank", "block", (begin - F.col("off")).alias("first"), (end - begin).alias("n"))
    # slots come of few short rows, and would pass for a table to broadcast
    return spans.join(slots.hint("merge"), ["rank", "block"]).select("_row", "epoch", "shard", "slot", "first", "n")


def _prepared(ws: Workspace, rows: DataFrame, weights, max_epochs, block_words, shard_slots, seed) -> tuple[DataFrame, DataFrame]:
    """Placed documents and the pieces that slots take of them; ``rows``: (_row, doc_id, source, size, _digest)."""
    sized = ws.save(rows, "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = ws.save(source_targets(totals, weights, max_epochs), "targets")  # one row a source
    placed = _offsets(ws, sized, targets)
    return placed, _pieces(placed, _slots(ws, targets, max_epochs, block_words, shard_slots, seed), block_words)


def _facts(row: Column, size: Column) -> list[Column]:
    """What places a row: rows of one id go by their texts, so that the order does not hang on how the table is split."""
    digest = F.xxhash64(F.col("text").cast("string")).alias("_digest")
    return [row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest]


def mix_blocks(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> DataFrame:
    """``(shard, slot, epoch, doc_id, first, n)``: which words, from ``first`` on, of which documents each slot of each output shard holds."""
    ws = Workspace(docs.sparkSession, "mix")
    rows = docs.select(*_facts(F.monotonically_increasing_id(), word_count(F.col("text").cast("string"))))
    placed, pieces = _prepared(ws, rows, weights, max_epochs, block_words, shard_slots, seed)
    return pieces.join(placed.select("_row", "doc_id"), "_row").select("shard", "slot", "epoch", "doc_id", "first", "n")


def mix_takes(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs`` (doc_id, source, text).

    A null or wordless text has size zero and is not taken; a null source is
    a source, the last; repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows = docs.select(*_facts(F.monotonically_increasing_id(), word_count(F.col("text").cast("string"))))
    placed, pieces = _prepared(ws, rows, weights, max_epochs, block_words, shard_slots, seed)
    taken = pieces.groupBy("_row").agg(F.sum("n").alias("taken"))
    return placed.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each document and epoch that takes words of it.

    The text is the whole one, or the taken blocks' words in order with the
    white space before each; ``n_chars`` follows, if there is such a column.
    Other columns stay as they are, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "mix")
    columns, own = docs.columns, own_names(docs, "row", "size", "take")
    row, size = own["row"], own["size"]
    kept = ws.save(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(size, word_count(F.col("text").cast("string"))), "documents")
    _, pieces = _prepared(ws, kept.select(*_facts(F.col(row), F.col(size))), weights, max_epochs, block_words, shard_slots, seed)
    takes = pieces.groupBy("_row", "epoch").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("ranges"))
    takes = takes.select(F.col("_row").alias(row), F.struct("n", "ranges").alias(own["take"]))
    taken = F.col(own["take"])

    def cut(words):  # words with the white space before them, extracted once a row
        parts = F.transform(taken["ranges"], lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["n"].cast("int")))
        return F.array_join(F.flatten(parts), "")

    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{WS}]*[^{WS}]+)"), F.lit(1))
    text = F.when(taken["n"] == F.col(size), F.col("text")).otherwise(F.element_at(F.transform(F.array(words), cut), 1))
    out = kept.join(takes, row).withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
