"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. quality: documents that the quality rules reject go.
2. lines: repeated lines are cut out of the texts.
3. near_duplicates: one row of each component of five-word shingle Jaccard 0.8 or more stays.
4. mixing: documents are taken as often, and as far, as the source targets say.
5. packing: what is left is packed into fixed-length token sequences.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; all but the last return the
columns of ``documents``.  Empty tables give empty results, null texts fail
the quality rules, and other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import linededup, mixing, packing, quality, simhash
from corvane.llm.queries import tokenizer_path
from corvane.llm.workspace import Workspace, read_table


def _wrapped(docs: DataFrame) -> DataFrame:
    """``(document, doc_id, text)``: all columns in one, so that none clashes with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), "doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(read_table(spark, sf_dir, "labels"))
    judged = quality.quality_verdicts(_wrapped(docs), trusted).withColumn("row", F.monotonically_increasing_id())
    # a filter on the row number stays above the verdict, which is then worked out once
    return judged.filter(F.col("kept") & (F.col("row") >= 0)).select("document.*")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.dedup_lines(_wrapped(docs))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of those with the smallest id the one with the smallest digest of id and text.

    Rows that agree in both are one document; which of them stays is open.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    rows = _wrapped(docs).withColumn("key", key)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    found = simhash.near_copies(rows, "key").withColumnRenamed("row", "key").distinct().join(rows.select("doc_id", "key").distinct(), "key")
    firsts = found.groupBy("component").agg(F.min(rank).alias("least")).select(F.col("least.key").alias("key"))
    return rows.join(firsts, "key", "left_semi").dropDuplicates(["key"]).select("document.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the SimHash nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and reread before the next."""
    ws, docs, before = Workspace(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
