"""Toxicity of deobfuscated text.

A noisy channel stands between what a writer means and what is written:
letters become look-alikes (``1d10t``), are spaced out (``i d i o t``) or
repeated (``idiiiot``).  Written spans of these kinds are turned into lattices
of the letters that may be meant, and Viterbi decoding under a character
trigram model restores the likeliest word.  The trigrams are counted over all
documents.  A logistic model over words of restored texts, and their beginnings, gives the score; it
is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, sample_ids
from .workspace import Workspace

SAMPLE_ROWS = 20_000
VOCABULARY = 400  # words of the model, those that tell most about the label
BEGINNINGS = (5, 7)  # lengths of the beginnings of words that are features too
OFTEN = 0.01  # share of a text's words at which a beginning's value is 1
LEAST_DOCS = 3  # documents of the sample that must hold a word
LEAST_RATIO = 7.0  # twice the log-likelihood ratio of a word and the label, below which it counts for chance
THRESHOLD = 0.3
REMEMBERED = 100_000  # spans whose restored form a worker keeps

#: The letters of the character model; 0 is a word's border, the last number any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýßœ"
SYMBOLS = 64
#: Letters that a written character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
SUBSTITUTED, LITERAL, DROPPED, JOINED, BROKEN, COLLAPSED = 0.5, 2.0, 8.0, 0.1, 1.0, 0.2  # costs in nats

_S = r"0-9@$!|+€(*"
_L = r"[^\W\d_]"
_U = r"(?:[^\W_]|[@$!])"
_T = rf"(?:[0-9]{{1,2}}+|[$@]{{1,2}}+|[!|+€(*])(?![{_S}\w])"  # look-alikes that end a word
SPACED = re.compile(rf"(?<![^\W_@$!]){_U}(?:[ ._\-]{{1,2}}{_U}){{2,}}(?![^\W_@$!])")
MIXED = re.compile(rf"(?<![^\W_])(?:[{_S}]*+{_L}++[{_S}]++{_L}|[{_S}]++{_L}|{_L}++{_T})(?:{_L}|[{_S}]++(?={_L})|{_T})*+")
#: What a text must hold for SPACED (between blanks) and MIXED to match in it.
MAYBE_SPACED = re.compile(rf"[\W_]{_U}[ ._\-]{{1,2}}{_U}(?![^\W_@$!])")
MAYBE_MIXED = re.compile(rf"[{_S}](?:(?={_L})|(?<={_L}[{_S}]))")
REPEATED = re.compile(rf"({_L})\1\1")
WORD = re.compile(rf"{_L}+")

_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    if chr(_c).isalpha():
        _TABLE[_c] = _NUMBER.get(chr(_c), SYMBOLS - 1)


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    return np.where(codes < 0x250, _TABLE[np.minimum(codes, 0x24F)], SYMBOLS - 1)


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(trigram, n)`` over every whole text: at most 64**3 rows."""

    def run(batches):
        total, held, waiting = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                s = _symbols(text.as_py() or "")
                for at in range(0, len(s), 1 << 20):  # bounded memory on very long texts
                    part = s[max(0, at - 2) : at + (1 << 20)]
                    part = np.concatenate([[0, 0], part]) if not at else part
                    part = np.concatenate([part, [0]]) if at + (1 << 20) >= len(s) else part
                    held.append(part[:-2] * SYMBOLS**2 + part[1:-1] * SYMBOLS + part[2:])
                    waiting += len(part)
                    if waiting >= 1 << 20:  # one count for many texts
                        total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
                        held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "trigram long, n long")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: dict[int, int], prior: float = 5.0) -> np.ndarray:
    """Log probabilities [before-last, last, next], interpolated down to single letters."""
    n = np.zeros(SYMBOLS**3)
    for trigram, seen in counts.items():
        n[trigram] = seen
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + SYMBOLS)
    pair = (two + prior * one) / (two.sum(axis=1, keepdims=True) + prior)
    return np.log((n + prior * pair[None]) / (n.sum(axis=2, keepdims=True) + prior))


@dataclass
class Restorer:
    """Decodes written spans under a character model."""

    log_p: np.ndarray
    kept: dict[str, str] = field(default_factory=dict, repr=False)

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each position the texts it may stand for ('' for nothing, a look-alike for itself) and their costs."""
        steps, at = [], 0
        while at < len(span):
            c, run = span[at], 1
            while at + run < len(span) and span[at + run] == c:
                run += 1
            if c in " ._-":  # two blanks end a word, one may
                steps.append([(" ", 0.0)] if run > 1 else [("", JOINED), (" ", BROKEN)])
            else:
                meant = [(x, SUBSTITUTED) for x in LOOKS_LIKE[c]] + [(c, LITERAL), ("", DROPPED)] if c in LOOKS_LIKE else [(c, 0.0)]
                steps.append(meant)
                if run == 2:
                    steps.append(meant)
                elif run > 2:  # one or two letters are meant
                    steps.append([("", COLLAPSED), *meant])
            at += run
        return steps

    def restore(self, span: str) -> str:
        """The likeliest reading of a lower-case span (Viterbi; a state is the last two symbols)."""
        if (done := self.kept.get(span)) is not None:
            return done
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in self.lattice(span):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in options:
                    if text == " ":
                        state, value = (b, 0), score - cost + self.log_p[a, b, 0]
                    elif text in LOOKS_LIKE:  # itself: it ends a word, if one has begun
                        state, value = (0, 0), score - cost + (self.log_p[a, b, 0] if b else 0.0)
                    elif text:
                        c = _NUMBER.get(text, SYMBOLS - 1)
                        state, value = (b, c), score - cost + self.log_p[a, b, c]
                    else:
                        state, value = (a, b), score - cost
                    if state not in after or value > after[state][0]:
                        after[state] = value, (path, text) if text else path
            best = after
        _, path = max(((score + (self.log_p[a, b, 0] if b else 0.0), path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, text = path
            letters.append(text)
        found = "".join(reversed(letters))
        if len(self.kept) < REMEMBERED:
            self.kept[span] = found
        return found

    def text(self, text: str | None) -> str:
        """The lower-case text with its obfuscated spans restored."""
        low = (text or "").lower()
        own = lambda m: self.restore(m[0])
        if MAYBE_SPACED.search(f" {low} "):
            low = SPACED.sub(own, low)
        if "$" in low or "@" in low or MAYBE_MIXED.search(low):
            low = MIXED.sub(own, low)
        codes = np.frombuffer(low.encode("utf-32-le"), dtype="<u4")
        if ((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])).any() and REPEATED.search(low):
            low = WORD.sub(lambda m: self.restore(m[0]) if REPEATED.search(m[0]) else m[0], low)
        return low

    def words(self, text: str | None) -> set[str]:
        return set(WORD.findall(self.text(text)))

    def features(self, text: str | None) -> dict[str, float]:
        """Values from 0 to 1: 1 for each word of the restored text; for words' beginnings (``begin*``) how often they come, up to ``OFTEN``."""
        counts = Counter(WORD.findall(self.text(text)))
        total, begun = max(1, counts.total()), Counter()
        for n in BEGINNINGS:
            for word, seen in counts.items():
                if len(word) >= n:
                    begun[word[:n] + "*"] += seen
        return dict.fromkeys(counts, 1.0) | {w: min(1.0, k / total / OFTEN) for w, k in begun.items()}


@dataclass
class ToxicityModel:
    """A restorer, weights of words and a bias."""

    restorer: Restorer
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        values = self.restorer.features(text)
        total = self.bias + math.fsum(self.weights[w] * values[w] for w in values.keys() & self.weights.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _logistic(rows: list[tuple[list[tuple[int, float]], int]], width: int, ridge: float = 0.1, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse rows (number, value), by Newton steps."""
    x = np.zeros((len(rows), width + 1))
    for i, (values, _) in enumerate(rows):
        for number, value in values:
            x[i, number] = value
    x[:, -1] = 1
    y = np.array([label for _, label in rows], dtype=float)
    w, penalty = np.zeros(width + 1), np.full(width + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> ToxicityModel:
    """Fits the model on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The character model counts all of ``docs``.  Labels come from at most
    ``rows`` ids that are not held out; without any, all scores are 0.  Of an
    id with several labels the largest counts, of several texts the smallest.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    counts = {r["trigram"]: r["n"] for r in character_counts(docs).collect()}  # at most 64**3 rows
    shared = spark.sparkContext.broadcast(language_model(counts))

    def run(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a bounded number of feature lists in memory
                part = batch.slice(at, 64)
                found = [sorted(restorer.features(t.as_py()).items()) for t in part.column(1)]
                flat = [pair for values in found for pair in values]
                pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.float64())], ["word", "value"])
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["toxic", "features"])

    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id").cast("long")))
    ids = sample_ids(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), rows)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # at most `rows` ids
    own = own.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("row.*")  # one row an id: within the bound
    sample = ws.save(own.select("toxic", "text").mapInArrow(run, "toxic int, features array<struct<word:string,value:double>>"), "sample")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return ToxicityModel(Restorer(shared.value), {}, -30.0)
    held = sample.select("toxic", F.inline("features")).filter("value >= 0.5")
    seen = held.groupBy("word").agg(F.sum("toxic").alias("k1"), F.count("*").alias("m"))
    seen = seen.filter((F.col("m") >= LEAST_DOCS) & (F.col("k1") * n > F.col("m") * bad))
    part = lambda k, m: F.when(k > 0, k * F.log(k * n / m)).otherwise(F.lit(0.0))
    k0 = F.col("m") - F.col("k1")
    ratio = 2 * (
        part(F.col("k1"), F.col("m") * bad) + part(k0, F.col("m") * (n - bad)) + part(bad - F.col("k1"), (n - F.col("m")) * bad)
        + part(n - bad - k0, (n - F.col("m")) * (n - bad))
    )
    told = seen.withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(vocabulary)
    words = [r["word"] for r in told.select("word").collect()]
    number = {w: i for i, w in enumerate(words)}
    few = F.filter("features", lambda f: f["word"].isin(words)) if words else F.slice("features", 1, 0)
    rows_found = sample.select("toxic", few.alias("few")).collect()  # at most `rows` rows of at most `vocabulary` values
    facts = [([(number[w], v) for w, v in r["few"]], r["toxic"]) for r in rows_found]
    weights, bias = _logistic(sorted(facts), len(words))
    return ToxicityModel(Restorer(shared.value), {w: float(x) for w, x in zip(words, weights, strict=True)}, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score)`` for every row, from the whole text alone.

    Null and empty texts get the score of a text without known words.  Rows
    are independent: repeated rows agree, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.restorer.log_p, model.weights, model.bias))

    def run(batches):
        log_p, weights, bias = shared.value
        own = ToxicityModel(Restorer(log_p), weights, bias)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double")
