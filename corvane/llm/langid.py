"""Hierarchical language identification: family first, then linear SVMs inside it.

Features are hashed character n-grams of the whole lower-cased text (1 to 3
characters), as square-rooted and length-normalised counts.  Languages are
grouped into families by how close their mean profiles are.  A linear model
picks the family; inside it one support vector machine for each pair of
languages votes.  The models are fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS``); every row is then classified where it lies, without a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, sample_ids

DIMENSIONS = 2048
SAMPLE_ROWS = 4000
FAMILY_CLOSENESS = 0.5  # languages join a family while their profiles' similarity is above this share of the range
NO_LANGUAGE = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of hashed n-gram counts of a whole text; zero for texts without characters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    counts = np.zeros(dimensions)
    for at in range(0, len(codes), 1 << 20):  # bounded memory on very long texts
        part = codes[max(0, at - 2) : at + (1 << 20)].astype(np.uint64)
        seen = min(at, 2)
        rolled = np.zeros(len(part), dtype=np.uint64)
        for order in (1, 2, 3):
            if len(part) < order:
                break
            rolled = rolled[: len(part) - order + 1] * np.uint64(0x100000001B3) + part[order - 1 :]
            hashed = ((rolled + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            new = hashed[max(0, seen - order + 1) :]
            counts += np.bincount((new % np.uint64(dimensions)).astype(np.int64), minlength=dimensions)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def _linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear SVM by stochastic subgradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, total, rng, turn = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.random.default_rng(7), 0
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 16):
            own = order[at : at + 16]
            turn += 1
            rate = 1 / (ridge * (turn + 1000))
            bad = own[y[own] * (x[own] @ weights) < 1]
            weights *= 1 - rate * ridge
            weights += rate / len(own) * ((y[bad] * share[bad]) @ x[bad])
        if epoch >= epochs // 2:
            total += weights
    return total / max(1, epochs - epochs // 2)


def _families(centres: np.ndarray, closeness: float) -> list[list[int]]:
    """Groups of languages, merged by average similarity of their mean profiles."""
    groups = [[i] for i in range(len(centres))]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    pairs = near[np.triu_indices(len(centres), 1)]
    if not len(pairs):
        return groups
    bar = pairs.min() + closeness * (pairs.max() - pairs.min())
    while len(groups) > 1:
        score, a, b = max((near[np.ix_(groups[a], groups[b])].mean(), a, b) for a, b in combinations(range(len(groups)), 2))
        if score <= bar:
            break
        groups[a] += groups.pop(b)
    return groups


@dataclass
class LanguageModel:
    """Families of language numbers, one linear model for each family and for each pair inside one."""

    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[int, int], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Languages and confidences of rows of features."""
        if not self.languages:
            return [None] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1))])
        scores = x @ self.family_weights.T
        family = scores.argmax(axis=1)
        margin = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
        sure = margin[np.arange(len(x)), family] / margin.sum(axis=1)
        chosen = np.zeros(len(x), dtype=int)
        for number, members in enumerate(self.families):
            rows = np.flatnonzero(family == number)
            votes = np.zeros((len(rows), len(members)))
            for a, b in combinations(range(len(members)), 2):
                first = 1 / (1 + np.exp(np.clip(-4 * (x[rows] @ self.pair_weights[members[a], members[b]]), -50, 50)))
                votes[:, a] += first
                votes[:, b] += 1 - first
            best = votes.argmax(axis=1)
            chosen[rows] = np.asarray(members)[best]
            if len(members) > 1:
                sure[rows] *= votes[np.arange(len(rows)), best] / (len(members) - 1)
        return [self.languages[i] for i in chosen], np.clip(sure, 0, 1)


def fit(texts: list[str], langs: list[str], dimensions: int = DIMENSIONS, closeness: float = FAMILY_CLOSENESS) -> LanguageModel:
    """Fits families and support vector machines on a sample that the caller bounds."""
    return fit_features(np.array([features(t, dimensions) for t in texts]).reshape(len(texts), dimensions), langs, closeness)


def fit_features(x: np.ndarray, langs: list[str], closeness: float = FAMILY_CLOSENESS) -> LanguageModel:
    languages = sorted(set(langs))
    y = np.array([languages.index(lang) for lang in langs], dtype=int)
    if not languages:
        return LanguageModel([], [], np.zeros((0, x.shape[1] + 1)), {})
    families = _families(np.array([x[y == i].mean(axis=0) for i in range(len(languages))]), closeness)
    of = {i: n for n, members in enumerate(families) for i in members}
    family = np.array([of[i] for i in y])
    rows = [_linear_svm(x, np.where(family == n, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for n in range(len(families))]
    pairs = {}
    for members in families:
        for a, b in combinations(members, 2):
            own = (y == a) | (y == b)
            pairs[a, b] = _linear_svm(x[own], np.where(y[own] == a, 1.0, -1.0))
    return LanguageModel(languages, families, np.array(rows), pairs)


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, lang)`` of at most ``rows`` labelled rows that are not held out."""
    return sample_ids(docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang"), rows)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> LanguageModel:
    """A model of ``docs`` (doc_id, text, lang); the driver gets ``rows`` feature vectors at most."""

    def run(batches):
        for batch in batches:
            keep = [(t, lang) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            vectors = [features(t, dimensions).astype("<f4").tobytes() for t, _ in keep]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array([lang for _, lang in keep], pa.string())], names=["x", "lang"])

    ids = training_sample(docs, rows).select("doc_id").distinct()
    own = docs.join(F.broadcast(ids), "doc_id", "left_semi")  # at most `rows` ids
    own = own.filter(F.col("lang").isNotNull()).select("doc_id", F.struct("text", "lang").alias("row"))
    own = own.groupBy("doc_id").agg(F.min("row").alias("row"))  # one row an id: within the bound
    sample = own.select("row.*").mapInArrow(run, "x binary, lang string").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in sample], dtype=np.float64).reshape(len(sample), dimensions)
    return fit_features(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: LanguageModel, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, from the text alone.

    A null text or one without a letter is ``und`` with score 1, as is any
    text under a model without languages (score 0).  Rows are independent:
    repeated rows agree, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                letters = [has_letter(t) for t in texts]
                found, sure = model.predict(np.array([features(t, dimensions) for t in texts]).reshape(len(texts), dimensions))
                langs = [(lang or NO_LANGUAGE) if ok else NO_LANGUAGE for lang, ok in zip(found, letters, strict=True)]
                scores = [float(s) if ok else 1.0 for s, ok in zip(sure, letters, strict=True)]
                columns = [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
