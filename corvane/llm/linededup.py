"""Line deduplication over levelled, sorted runs of line hashes.

The store of seen lines is a set of runs: tables of ``(h1, h2, n_docs, owner)``,
bucketed and sorted by hash, so that they are joined and merged as they lie,
without an exchange.  Batches of documents arrive from the largest ids down, each
about twice as large as the one before, so that all batches together read the store
a few times only.  A new batch is merge-anti-joined with the runs: lines
that no run holds enter with their owner, the largest id of the batch that has
them; lines that a run holds have an owner already and only add to its count.
Both make the batch's own run at level 0.  When a level has ``FANOUT`` runs they are
merged into one run of the next level, so each hash is rewritten a
logarithmic number of times.

A line of a text is then dropped when the merged runs count its key in at
least ``min_docs`` documents and its owner is another, larger id.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, own_names

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 8
FANOUT = 2
NO_ID = -(2**63)  # stands in for a null id, which sorts below all others
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> Column:
    """128 bits of a key, as two independently seeded longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _line_hashes(text: Column, min_chars: int) -> Column:
    keys = F.transform(lines_of(text), line_key)
    return F.transform(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars)), _hashes)


class LineRuns:
    """Levelled runs in a workspace; ``levels`` holds ``(name, run)``, the newest last."""

    def __init__(self, ws: Workspace, fanout: int = FANOUT):
        self.ws, self.fanout, self.levels, self.made = ws, fanout, [[]], 0
        self.buckets = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        return name, self.ws.save_bucketed(df, name, KEY, self.buckets)

    def _newest_first(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in reversed(level)]

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Runs, the newest first, as one: counts add up, and the one owner is kept."""
        both = runs[0]
        for older in runs[1:]:
            older = older.select(*KEY, F.col("n_docs").alias("n_older"), F.col("owner").alias("owner_older"))
            joined = both.join(older, KEY, "full")
            counts = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_older", F.lit(0))
            both = joined.select(*KEY, counts.cast("long").alias("n_docs"), F.coalesce("owner", "owner_older").alias("owner"))
        return both

    def drop(self) -> None:
        """Deletes all runs."""
        self.ws.drop_bucketed(*(name for level in self.levels for name, _ in level))
        self.levels = [[]]

    def merged(self) -> DataFrame:
        return self._merge(self._newest_first())

    def add(self, lines: DataFrame) -> None:
        """``lines``: one row ``(doc_id, h1, h2)`` for each document and key, ids below those of earlier batches."""
        own = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        known = []
        for number, run in enumerate(self._newest_first()):
            known.append(F.col(f"known_{number}"))
            own = own.join(run.select(*KEY, F.lit(True).alias(f"known_{number}")), KEY, "left")
        # the anti-joined rows are new and own their line, the others only count
        owner = F.when(F.coalesce(*known).isNull(), F.col("owner")) if known else F.col("owner")
        self.levels[0].append(self._write(own.select(*KEY, "n_docs", owner.alias("owner"))))
        for number, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if number + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[number + 1].append(self._write(self._merge([run for _, run in reversed(level)])))
                self.ws.drop_bucketed(*(name for name, _ in level))
                level.clear()


def _cuts(ids: DataFrame, batches: int) -> list[int]:
    """Ids at which batches end, the largest first, each batch twice as large as the one before; where exactly does not matter for the result."""
    shares = [1 - (2**i - 1) / (2**batches - 1) for i in range(1, batches)]
    at = ids.select(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    return sorted(set(at or []), reverse=True)


def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """What is left of each text without the lines whose key has one of the hashes ``drops``, and how many lines went."""
    table, kept, dropped = str.maketrans(UPPER, LOWER), [], []
    for text, gone in zip(texts, drops, strict=True):
        if gone is None:
            kept.append(None), dropped.append(None)
            continue
        lost, lines = set(gone.tolist()), text.split("\n")
        digests = (xxhash.xxh64_intdigest(line.strip(BLANKS).translate(table).encode(), 42) for line in lines)
        left = [line for line, h in zip(lines, digests, strict=True) if h - (h >> 63 << 64) not in lost]
        kept.append("\n".join(left)), dropped.append(len(lines) - len(left))
    return pd.DataFrame({"kept": pd.Series(kept, dtype=object), "dropped": pd.Series(dropped, dtype="Int64")})


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Each row is a document; rows that repeat an id count one by one, and all
    rows with the owner's id keep its lines.  A null id is smaller than any
    other.  Null and empty texts have one empty line, which stays.  An empty
    table gives no rows.  Own columns with the names of results are replaced,
    all others stay, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "lines")
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    text = F.col(text_col).cast("string")
    own = own_names(docs, "id", "digest", "drop", "left")
    keyed = docs.withColumn(own["id"], F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(own["digest"], F.xxhash64(text))
    cuts = _cuts(docs.select(F.col(id_col).cast("long").alias("doc_id")), batches)
    turn = F.lit(0)
    for number, cut in enumerate(cuts, 1):
        turn = F.when(F.col("doc_id") <= cut, number).otherwise(turn)
    hashed = keyed.select(F.col(own["id"]).alias("doc_id"), F.col(own["digest"]).alias("digest"), F.explode(_line_hashes(text, min_chars)).alias("h"))
    lines = ws.save(hashed.select("doc_id", "digest", "h.h1", "h.h2", turn.alias("turn")), "lines", ["turn"])
    runs = LineRuns(ws)
    for number in range(len(cuts) + 1):
        runs.add(lines.filter(F.col("turn") == number).drop("turn"))
    repeated = ws.save(runs.merged().filter(F.col("n_docs") >= min_docs).select(*KEY, "owner"), "repeated")
    lost = lines.join(repeated, KEY).filter(F.col("doc_id") < F.col("owner"))
    # rows of one id and text lose the same lines; 64 bits tell the lines of one text apart
    drops = lost.groupBy(F.col("doc_id").alias(own["id"]), F.col("digest").alias(own["digest"])).agg(F.collect_set("h1").alias(own["drop"]))
    drops = ws.save(drops, "drops")
    runs.drop()
    ws.drop("lines", "repeated")
    met = keyed.join(drops, [own["id"], own["digest"]], "left")
    drop, left = F.col(own["drop"]), F.col(own["left"])
    cut_down = F.pandas_udf(_without, "kept string, dropped long")
    met = met.withColumn(own["left"], cut_down(F.when(drop.isNotNull(), F.coalesce(text, F.lit(""))), drop))
    whole = F.coalesce(text, F.lit(""))
    n_lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    return met.select(
        *docs.columns, n_lines.cast("long").alias("n_lines"), F.coalesce(left["dropped"], F.lit(0)).cast("long").alias("n_dropped"),
        F.when(drop.isNull(), whole).otherwise(left["kept"]).alias("kept_text"),
    )
