"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by gradient descent.

A text's features are the runs of one to four letters within its words, borders included, hashed into buckets. Each
bucket has a small embedding; a text is the average over all its features, and a linear layer gives a score a language.
As both layers are linear, a trained model is one table of scores by bucket, so that whole texts of any length take one
look-up a feature. Scores are calibrated by a temperature fitted on texts that training has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import of_worker, share, values
from versewright.llm.ngrams import ngrams

BITS, DIMENSIONS, LONGEST = 16, 16, 4
BUCKETS = 1 << BITS
#: Labelled rows that a model is fitted on, at most twice as many; a documented bound of the fit, not of the prediction.
SAMPLE_ROWS = 2000
EPOCHS, RATE = 6, 0.5
#: A prediction of a lower calibrated probability is rejected. Under one half, so that texts of two known languages stay.
LEAST_SCORE = 0.4
UNDETERMINED = "und"

def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of the features of a text, occurrence by occurrence, in steps of bounded size."""
    return ngrams(text, 1, LONGEST, BITS)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([*features(text), np.zeros(0, np.int64)])
    return np.unique(found, return_counts=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # scores by bucket and language
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and 0 where the text has no letter."""
        total, count = np.zeros(len(self.languages)), 0
        for found in features(text or ""):
            total += np.add.reduce(self.table[found], axis=0)
            count += len(found)
        if not count or not self.languages:
            return UNDETERMINED, 0.0
        scores = _softmax((total / count + self.bias) / self.temperature)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 11) -> Model:
    """Fit on ``(language, buckets, counts)``; every fifth sample is kept for the calibration.

    Without samples the model knows no language and leaves every text undetermined.
    """
    samples = [s for s in samples if len(s[1])]
    languages = sorted({s[0] for s in samples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    number = {c: i for i, c in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = set(order[::5].tolist()) if len(samples) >= 20 * len(languages) else set()
    fit = [i for i in order.tolist() if i not in held]
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit).tolist():
            language, buckets, counts = samples[i]
            share = counts / counts.sum()
            hidden = share @ embeddings[buckets]
            error = _softmax(hidden @ weights + bias)
            error[number[language]] -= 1
            rate = RATE * (1 - done / steps)
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            embeddings[buckets] -= rate * 20 * share[:, None] * back
            done += 1
    table = embeddings @ weights
    checked = [samples[i] for i in (sorted(held) or fit)]
    logits = np.array([(c / c.sum()) @ table[b] + bias for _, b, c in checked])
    truth = np.array([number[s[0]] for s in checked])
    loss = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    return Model(languages, table.astype(np.float32), bias, float(min(loss, key=loss.get)))


#: Lengths of the excerpts that training sees besides the whole text, so that scores hold for short texts too.
EXCERPTS = (40, 160, 640)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], []]
        for language, digest, text in zip(batch.column("lang").to_pylist(), batch.column("digest").to_pylist(), values(batch.column("text"))):
            parts = [text]
            for length in EXCERPTS:
                if length < len(text):
                    start = digest % (len(text) - length)
                    parts.append(text[start:start + length])
            for part in parts:
                buckets, counts = _counts(part)
                out[0].append(language)
                out[1].append(buckets.astype(np.int32))
                out[2].append(counts.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32()))],
            ["lang", "buckets", "counts"])


def fitted(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    """A model from the texts and non-null ``lang`` of ``docs`` where ``usable``, learned from about ``rows`` of them.

    Rows are taken by a hash of id and text, so that the same table gives the same model; at most ``2 * rows`` in any case.
    The tasks turn texts into counts, and the driver gets those of the sample alone.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") > 0) & usable)
    share = min(1.0, rows / max(1, known.count()))
    mixed = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 24))
    picked = known.where(mixed <= int(share * (1 << 24))).limit(2 * rows)
    picked = picked.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("digest"))
    found = picked.mapInArrow(_sampled, "lang string, buckets array<int>, counts array<int>").toArrow()
    samples = list(zip(found.column("lang").to_pylist(), *(
        [x.values.to_numpy(zero_copy_only=False) for c in found.column(name).chunks for x in c] for name in ("buckets", "counts"))))
    return train(sorted(samples, key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes())))


COLUMN = "__langid_text"


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of_worker(shared)
        for batch in batches:
            found = [model.predict(t) for t in values(batch.column(COLUMN))]
            columns = {c: batch.column(c) for c in batch.schema.names if c != COLUMN}
            columns |= {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    return predict


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), least_score: float = LEAST_SCORE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` and ``accepted`` for every whole text.

    ``lang_pred`` is the likeliest language that the model knows, or ``und`` with score 0 if the text is null or has no
    letter. ``accepted`` is false for ``und`` and for scores below ``least_score``. Only the text counts, so repeated rows
    get equal results; an empty table gives an empty one. Columns of ``keep`` named like a result are replaced by it.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "accepted"))
    rows = docs.select(*keep, F.col("text").alias(COLUMN))
    schema = rows.drop(COLUMN).schema.add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(_predictor(share(docs.sparkSession, model)), schema)
    return out.withColumn("accepted", (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
