"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are compared: a trusted one (texts
labelled good, a bounded sample of labels) and the raw one (every text); both
count equal texts once.  The n-grams are words, pairs of words and shapes: runs of
characters other than letters, digits and white space, which recur where words don't.
A document's score is the sum of its n-grams' log ratios divided by their
number, in units of ``UNIT`` nats; it is kept if the score reaches a fixed
threshold.  Everything is DataFrame functions: the raw counts are one
aggregation over all n-grams of distinct texts with map-side combining into ``buckets`` rows, and
scoring reads the ratios from an array constant, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import sample_ids

WS = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"  # the same characters
BUCKETS = 65536  # rows of the ratio table, whatever the corpus holds
UNIT = 1e-4  # nats; ratios are rounded to it, so that sums are exact integers
SHAPE = rf"[^\p{{L}}\p{{N}}{WS}]+"
PRIOR = 16  # prior n-grams of either multinomial, for each bucket
THRESHOLD = -0.1  # nats an n-gram
TRUSTED_LIMIT = 20_000  # labels used for the trusted multinomial, by hash order
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, f"[{WS}]+")).otherwise(F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def shape_hashes(text: Column) -> Column:
    """Hashes of the text's runs of characters that are no letters, digits or white space."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SHAPE})")), lambda w: F.xxhash64(w, F.lit("shape")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rolled(shorter: Column, hashes: Column, order: int) -> Column:
    """Hashes of the ``order`` words from each position on, from those of one word less and the words' own."""
    n = F.greatest(F.size(hashes) - (order - 1), F.lit(0))
    return F.zip_with(F.slice(shorter, 1, n), F.slice(hashes, order, n), lambda a, b: F.xxhash64(a, b))


def _words_in_repeats(hashes: Column, width: int) -> Column:
    """Words covered by windows whose 64-bit hash occurs at least twice in the row; ``hashes`` is a column, not worked out here."""

    def covered(order):
        m = F.greatest(F.size(order) - 1, F.lit(0))
        next_to = F.arrays_zip(F.slice(order, 1, m).alias("x"), F.slice(order, 2, m).alias("y"))
        twins = F.filter(next_to, lambda p: p["x"]["h"] == p["y"]["h"])
        places = F.array_sort(F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["x"]["i"], p["y"]["i"])))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, covered))


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``words``, ``pairs`` and ``shapes`` (hashes) and the base columns; a null text has no word and one empty line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    listed = docs.withColumn("words", word_hashes(F.col(text_col).cast("string"))).withColumn("pairs", _rolled(F.col("words"), F.col("words"), 2))
    listed = listed.withColumn("_triples", _rolled(F.col("pairs"), F.col("words"), 3)).withColumn("shapes", shape_hashes(text)).withColumn("_lines", lines)
    out = listed.select(
        *[c for c in listed.columns if c not in ("_lines", "_triples")],
        F.size("words").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{WS}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _words_in_repeats(F.col("_triples"), 3).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most ``limit`` distinct ids that are labelled good, in hash order."""
    return sample_ids(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log ratio of trusted to raw for each bucket, in ``UNIT``; raw covers every text of ``docs``.

    ``trusted`` has one column ``doc_id`` and at most ``TRUSTED_LIMIT`` rows.
    Either side counts a text once, however many rows hold it; it is trusted if
    one of them is.  Raw counts are scaled to the number of trusted n-grams, and both
    multinomials have the same symmetric Dirichlet prior, so that a ratio leaves
    zero only as far as its counts bear it, in tables of any size.  They are all
    zero if no trusted document has an n-gram.
    """
    marked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("is_trusted"))), "doc_id", "left"
    )
    texts = marked.groupBy("text").agg(F.max("is_trusted").alias("is_trusted"))
    texts = texts.select(word_hashes(F.col("text")).alias("words"), shape_hashes(F.col("text")).alias("shapes"), "is_trusted")
    grams = texts.select(F.explode(F.concat("words", _rolled(F.col("words"), F.col("words"), 2), "shapes")).alias("h"), "is_trusted")
    grams = grams.select(F.pmod("h", F.lit(buckets)).alias("bucket"), "is_trusted")
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_trusted").alias("good")).collect()  # at most `buckets` rows
    n_raw, n_good, ratios = sum(r["raw"] for r in rows), sum(r["good"] for r in rows), [0] * buckets
    for r in rows:
        ratios[r["bucket"]] = round(math.log((r["good"] + PRIOR) / (r["raw"] * n_good / n_raw + PRIOR)) / UNIT)
    return ratios


def quality_verdicts(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with the base columns, ``llr`` (nats an n-gram) and ``kept``.

    Null and empty texts have zero counts, fail the base rules and are not
    kept; repeated rows are judged alike; an empty table gives no rows.  Own
    columns with the names of results are replaced, others stay.
    """
    own = {"words", "pairs", "shapes", "_lines", "_triples", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "_grams", "_sum"}
    docs = docs.drop(*(own & set(docs.columns)))
    ratios = log_ratios(docs, trusted, buckets)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded to one constant
    grams = word_statistics(docs, text_col).withColumn("_grams", F.concat("words", "pairs", "shapes"))
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))
    scored = grams.withColumn("_sum", total).withColumn("llr", F.col("_sum") * F.lit(UNIT) / F.greatest(F.size("_grams"), F.lit(1)))
    reached = F.col("_sum") >= F.lit(round(threshold / UNIT)) * F.size("_grams")
    return scored.withColumn("kept", ~F.col("base_failed") & reached).drop("words", "pairs", "shapes", "_grams", "_sum")
