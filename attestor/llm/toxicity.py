"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this row must not be learned from: crc32 of the id as text is divisible by 5 (null: as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """A linear model of which words occur."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in self.weights.keys() & words_of(text))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    return np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, l1: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam with a proximal L1 step.

    risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): unlabelled text counts as clean, less the
    share of toxic text in it. Where that difference falls below zero its gradient is turned round, so that the fit to the
    unlabelled part is undone instead of pressed on.
    """
    w = np.zeros(features + 1)  # the last is the bias
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    parts = [_rows(positive), _rows(unlabelled)]

    def forward(part: tuple) -> np.ndarray:
        col, row, n = part
        z = np.bincount(row, weights=w[col], minlength=n) + w[features]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradient(part: tuple, d: np.ndarray) -> np.ndarray:
        col, row, n = part
        g = np.bincount(col, weights=d[row], minlength=features + 1) / n
        g[features] = d.mean()
        return g

    for step in range(1, steps + 1):
        p, u = forward(parts[0]), forward(parts[1])
        negative = -np.log(np.maximum(1 - u, 1e-12)).mean() + prior * np.log(np.maximum(1 - p, 1e-12)).mean()
        rest = gradient(parts[1], u) - prior * gradient(parts[0], p)
        g = prior * gradient(parts[0], p - 1) + rest if negative >= 0 else -rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= pace * m / (1 - 0.9**step)
        w[:features] = np.sign(w[:features]) * np.maximum(np.abs(w[:features]) - pace[:features] * l1, 0)
    return w[:features], float(w[features])


def learn(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, features: int = 2000, least_documents: int = 3, sparsity: float = 5e-4) -> Model:
    """A model from confirmed toxic documents and unlabelled text.

    Only labels of rows that are not held out are read. The class prior is their mean. Of toxic documents at most
    `most_positive` are used, of all documents at most `most_unlabelled` (as unlabelled text), both by the order of a hash of
    doc_id: these bounds keep the fit on one machine. Words are kept by chi-square between the two samples. A doc_id with
    several labels is toxic if one says so; null labels and null ids count for nothing. Without any toxic example the model
    scores everything 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return Model({}, -60.0)
    by_hash = F.xxhash64("doc_id", F.lit(8))
    toxic = known.where("toxic = 1").select("doc_id").orderBy(by_hash, "doc_id").limit(most_positive)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).orderBy(by_hash, "doc_id").limit(most_unlabelled)
    chosen = toxic.withColumn("positive", F.lit(True)).union(free.withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most most_positive + most_unlabelled ids
    sets: dict[bool, list[np.ndarray]] = {True: [], False: []}
    known_words: dict[str, int] = {}
    for row in texts.select("positive", "text").toLocalIterator():
        sets[row.positive].append(np.fromiter((known_words.setdefault(w, len(known_words)) for w in words_of(row.text)), np.int32))
    positive, unlabelled = sets[True], sets[False]
    if not positive or not unlabelled:
        return Model({}, -60.0)
    counts = [np.bincount(_rows(s)[0], minlength=len(known_words)) for s in (positive, unlabelled)]
    a, c = counts
    n, k = len(positive), len(unlabelled)
    both = a + c
    expected = both * n / (n + k)
    chi = (a - expected) ** 2 / np.maximum(expected, 1e-9) + (c - (both - expected)) ** 2 / np.maximum(both - expected, 1e-9)
    chi[both < least_documents] = 0
    best = np.sort(np.argsort(-chi, kind="stable")[:features])
    best = best[chi[best] > 0]
    place = np.full(len(known_words) + 1, -1)
    place[best] = np.arange(len(best))
    cut = lambda s: [x[x >= 0] for x in (place[y] for y in s)]
    w, _ = fit_nnpu(cut(positive), cut(unlabelled), len(best), prior, sparsity)
    best = best[w != 0]  # fit again, with a fifth of the penalty, on the words that the sparse fit chose
    place[:] = -1
    place[best] = np.arange(len(best))
    w, bias = fit_nnpu(cut(positive), cut(unlabelled), len(best), prior, sparsity / 5)
    names = {i: word for word, i in known_words.items()}
    return Model({names[i]: float(x) for i, x in zip(best.tolist(), w, strict=True) if x}, bias)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of docs and the score as `name` (replaced if there), 0 to 1, from the whole text alone. Null text counts as empty."""
    docs = docs.drop(name)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            s = pa.array([model.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))
