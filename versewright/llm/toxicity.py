"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a text holds a hashed run of four to six letters within a word. Each is scaled by the logarithm of
the ratio of its (smoothed) shares in toxic and other texts, and a logistic regression on the scaled features, trained
with the classes' real weights, gives the score. Runs whose ratio isn't clear from the sample get no weight, so that long
texts don't gather noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import labelled_sample, of_worker, share, values
from versewright.llm.ngrams import ngrams

SHORTEST, LONGEST, BITS = 4, 6, 18
#: Labelled rows of each class that a model is fitted on; a documented bound of the fit, not of the scores.
SAMPLE_ROWS = 4000
SMOOTHING = 1.0
#: A run counts if so many sampled texts hold it, and its log ratio is so many standard errors away from zero.
LEAST_TEXTS, CLEAR = 5, 4.0
L2, ROUNDS, RATE = 1e-4, 400, 0.05
#: Tasks that count the runs of the sample; each hands on one row a bucket at most.
COUNTERS = 8


def present(text: str) -> np.ndarray:
    """The different buckets of a text."""
    seen = np.zeros(1 << BITS, bool)
    for found in ngrams(text, SHORTEST, LONGEST, BITS):
        seen[found] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # by bucket, the ratio included
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        logit = self.bias + float(self.weights[present(text or "")].sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), values(batch.column("text"))):
            counts[label, present(text)] += 1
    found = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[0, found]), pa.array(counts[1, found])], ["bucket", "clean", "toxic"])


def _chosen(shared):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = of_worker(shared)
        for batch in batches:
            found = [number[present(t)] for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("weight"), pa.array([x[x >= 0] for x in found], pa.list_(pa.int32()))],
                ["label", "weight", "features"])

    return choose


def _regression(labels: np.ndarray, weights: np.ndarray, features: list[np.ndarray], ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by gradient descent with momentum and adapted steps."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    share_of = weights / weights.sum()
    w, b = np.ones(len(ratios)), float(np.log(share_of @ labels / (1 - share_of @ labels)))
    point = np.append(w, b)
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for t in range(1, ROUNDS + 1):
        logits = np.bincount(rows, point[columns] * ratios[columns], len(labels)) + point[-1]
        error = share_of * (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels)
        slope = np.append(np.bincount(columns, error[rows] * ratios[columns], len(ratios)) + L2 * point[:-1], error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        point -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return point[:-1], float(point[-1])


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_ROWS) -> Model:
    """A model from ``labels (doc_id, toxic)`` where ``usable``, learned from about ``per_class`` rows of each class.

    Without rows of both classes every text gets the same score: the share of toxic rows, 0 without any row.
    """
    sample = labelled_sample(docs, labels, "toxic", usable, per_class)
    sizes = {r["label"]: (r["n"], r["weight"]) for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    if len(sizes) < 2:
        share_of = float(1 in sizes)
        return Model(np.zeros(1 << BITS), 30.0 if share_of else -30.0, share_of)
    prior = sizes[1][1] / (sizes[0][1] + sizes[1][1])
    counts = sample.select("label", "text").repartition(COUNTERS).mapInArrow(_count, "bucket long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    clean, toxic = F.col("clean") + SMOOTHING, F.col("toxic") + SMOOTHING
    counts = counts.select("bucket", F.log(toxic / (sizes[1][0] + 2 * SMOOTHING) / (clean / (sizes[0][0] + 2 * SMOOTHING))).alias("ratio"), F.sqrt(1 / clean + 1 / toxic).alias("error"))
    chosen = sorted((r["bucket"], r["ratio"]) for r in counts.where(F.abs("ratio") >= CLEAR * F.col("error")).collect())
    number = np.full(1 << BITS, -1, np.int32)
    number[[b for b, _ in chosen]] = np.arange(len(chosen))
    ratios = np.array([r for _, r in chosen])
    rows = sample.mapInArrow(_chosen(share(docs.sparkSession, number)), "label int, weight double, features array<int>").toArrow()
    features = [x.values.to_numpy(zero_copy_only=False) for c in rows.column("features").chunks for x in c]
    w, bias = _regression(rows.column("label").to_numpy().astype(float), rows.column("weight").to_numpy(), features, ratios)
    weights = np.zeros(1 << BITS)
    weights[[b for b, _ in chosen]] = w * ratios
    return Model(weights, bias, prior)


COLUMN = "__toxicity_text"


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of_worker(shared)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names if c != COLUMN}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array([model.score(t) for t in values(batch.column(COLUMN))], pa.float64())})

    return score


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``, the probability that the whole text is toxic.

    A null text counts as empty and gets the score of a text without any feature. Only the text counts, so repeated rows
    get equal scores; an empty table gives an empty one. A column of ``keep`` named ``score`` is replaced.
    """
    rows = docs.select(*[c for c in keep if c != "score"], F.col("text").alias(COLUMN))
    return rows.mapInArrow(_scorer(share(docs.sparkSession, model)), rows.drop(COLUMN).schema.add("score", "double"))
