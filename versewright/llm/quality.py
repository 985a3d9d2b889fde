"""Quality by compression: zstandard with a dictionary of good and one of bad labelled text.

A text is cut into short chunks, each compressed on its own with both dictionaries, so that what a dictionary knows
counts however long the text is. The difference of the compressed sizes, as a share of the text's size, is what tells good
from bad: a text that repeats itself is small either way and so no more than neutral. A rising curve fitted on labelled
texts that the dictionaries haven't seen makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import labelled_sample, of_worker, share, values

#: Labelled rows of each class that a model is fitted on; a documented bound of the fit, not of the scores.
SAMPLE_ROWS = 4000
#: Bytes of a chunk, of each dictionary and of what a sampled text gives to it (more if there are few).
CHUNK, DICTIONARY, EXCERPT, LONGEST_EXCERPT = 128, 1 << 18, 256, 8192
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    differences: list[float]  # rising, with the probability at each
    probabilities: list[float]


class Scorer:
    """A model with its compressors."""

    def __init__(self, model: Model):
        self.model = model
        self.compressors = []
        for content in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=dictionary, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, data: bytes) -> float:
        """From -1 to 1; larger if the dictionary of good text saves more. 0 for no text."""
        good, bad = (c.compress for c in self.compressors)
        saved = 0
        for start in range(0, len(data), CHUNK):
            chunk = data[start:start + CHUNK]
            saved += len(bad(chunk)) - len(good(chunk))
        return saved / max(1, len(data))

    def score(self, data: bytes) -> float:
        known = self.model.probabilities
        if len(known) == 1:
            return known[0]
        return float(np.interp(self.difference(data), self.model.differences, known))


def _differences(shared):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = of_worker(shared, Scorer)
        for batch in batches:
            found = [scorer.difference(t) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(found, pa.float64())], ["label", "weight", "difference"])

    return measure


def calibrated(labels: np.ndarray, weights: np.ndarray, x: np.ndarray) -> tuple[list[float], list[float]]:
    """Places and heights of the rising curve of least weighted squares, by pooling neighbours that fall.

    Between the means of two pools the curve is straight. Half a row of the other kind counts at both ends, so that no
    probability is 0 or 1.
    """
    half = 0.5 * weights.mean()
    x, labels, weights = (np.concatenate(v) for v in (([x.min() - 1e-9, x.max() + 1e-9], x), ([1.0, 0.0], labels), ([half, half], weights)))
    pools: list[list[float]] = []  # weight, sum of x, sum of labels
    for k in np.lexsort((labels, x)):
        pools.append([weights[k], weights[k] * x[k], weights[k] * labels[k]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[1] / p[0] for p in pools], [p[2] / p[0] for p in pools]


def dictionary(chunks: list[bytes]) -> bytes:
    """A dictionary's content: chunks of all texts, as many as fit."""
    return b"".join(chunks)[-DICTIONARY:]


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_ROWS) -> Model:
    """A model from ``labels (doc_id, quality)`` where ``usable``, learned from about ``per_class`` rows of each class.

    Half of the sampled rows gives the dictionaries, one chunk from a place within each text, the other half the
    calibration. Without rows of both classes every text gets the same score: the share of good rows, 0 without any row.
    """
    sample = labelled_sample(docs, labels, "quality", usable, per_class)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(b"", b"", [0.0], [float(1 in sizes)])
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    hashed = F.xxhash64("text", F.lit(9))
    length = {k: min(LONGEST_EXCERPT, max(EXCERPT, 2 * DICTIONARY // n)) for k, n in sizes.items()}
    length = F.when(F.col("label") == 1, length[1]).otherwise(length[0])
    start = F.pmod(hashed, F.greatest(F.lit(1), F.length("text") - length)).cast("int") + 1
    chunks = sample.where(half == 0).select("label", hashed.alias("hash"), F.col("text").substr(start, length).alias("chunk"))
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    for row in chunks.distinct().orderBy("label", "hash").collect():
        by_label[row["label"]].append(row["chunk"].encode("utf-8"))
    good, bad = dictionary(by_label[1]), dictionary(by_label[0])
    size = min(len(good), len(bad))  # neither side knows more for being larger
    model = Model(good[-size:], bad[-size:], [0.0], [0.5])
    rest = sample.where(half == 1).select("label", "weight", F.col("text").cast("binary").alias("text"))
    rows = rest.mapInArrow(_differences(share(docs.sparkSession, model)), "label int, weight double, difference double").toArrow()
    if not rows.num_rows:
        return model
    model.differences, model.probabilities = calibrated(*(rows.column(c).to_numpy().astype(float) for c in ("label", "weight", "difference")))
    return model


COLUMN = "__quality_text"


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = of_worker(shared, Scorer)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names if c != COLUMN}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array([scorer.score(t or b"") for t in values(batch.column(COLUMN))], pa.float64())})

    return score


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``, the probability that the whole text is good.

    A null text counts as empty: no difference, so the score of the curve's middle. Only the text counts, so repeated rows
    get equal scores; an empty table gives an empty one. A column of ``keep`` named ``score`` is replaced.
    """
    rows = docs.select(*[c for c in keep if c != "score"], F.col("text").cast("binary").alias(COLUMN))
    return rows.mapInArrow(_scorer(share(docs.sparkSession, model)), rows.drop(COLUMN).schema.add("score", "double"))
