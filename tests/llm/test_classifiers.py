import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewright.llm import langid, ngrams, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def joined(spark, name, label, table="labels"):
    other = spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", F.col(label).alias("truth"))
    return queries.QUERIES[name](spark, SF).join(other, "doc_id").toPandas()


def area(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    positive = truth == 1
    return (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_languages_of_held_out_texts(spark):
    found = joined(spark, "op7_language_id", "lang", "documents")
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and len(held) > 2000
    assert (held.lang_pred == held.truth).mean() > 0.99 and held.accepted.mean() > 0.99
    assert held.score.between(0, 1).all()


def test_toxic_held_out_texts(spark):
    found = joined(spark, "op9_toxicity", "toxic")
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and len(held) > 500
    assert area(held.score.values, held.truth.values) > 0.97 and (held.predicted == held.truth).mean() > 0.97


def test_quality_of_held_out_texts(spark):
    found = joined(spark, "op8_quality", "quality")
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and len(held) > 500
    assert area(held.score.values, held.truth.values) > 0.95 and (held.predicted == held.truth).mean() > 0.94


@pytest.mark.parametrize("text", ["", "a", "Ab, cd!", "éÀß ñ", "abc" * 50, "x1y", " . "])
@pytest.mark.parametrize("shortest, longest", [(1, 4), (4, 6)])
def test_ngrams_by_brute_force(text, shortest, longest):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    wanted = sorted(
        len(g) for w in letters.split() for n in range(shortest, longest + 1) for i in range(len(w) + 3 - n) for g in [f" {w} "[i:i + n]] if g != " ")
    found = [len(x) for x in ngrams.ngrams(text, shortest, longest, 16)]
    assert sum(found) == len(wanted)
    for own in ngrams.ngrams(text, shortest, longest, 16):
        assert ((own >= 0) & (own < 1 << 16)).all()


def test_ngrams_in_steps_are_the_same(monkeypatch):
    text = " ".join(random.Random(1).choices(["stupid", "worthless", "river", "xy"], k=200))
    whole = set(np.concatenate(list(ngrams.ngrams(text, 4, 6, 18))).tolist())
    monkeypatch.setattr(ngrams, "STEP", 50)
    assert whole <= set(np.concatenate(list(ngrams.ngrams(text, 4, 6, 18))).tolist())


def test_rising_curve():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    places, heights = quality.calibrated(np.array([0.0, 1, 0, 1, 1, 1]), np.ones(6), x)
    assert heights == sorted(heights) and places == sorted(places) and 0 < heights[0] and heights[-1] < 1


def test_language_of_odd_rows(spark, odd, empty):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(words, k=20)), lang, "s", 1) for i in range(60) for lang, words in (("en", ["wide", "river", "no", "line"]), ("de", ["ein", "Wort", "noch", "und"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fitted(docs, F.lit(True))
    found = langid.identified(odd, model, ("doc_id", "text", "score", "accepted"))
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    for r in found.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred == ("de" if "Wort" in r.text else "en") and 0 <= r.score <= 1
    assert langid.identified(empty, model).count() == 0
    nothing = langid.fitted(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identified(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows(spark, odd, empty, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (7, 1), (7, 0), (None, 1), (6, None), (99, 1), (4, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.where(f"{label} = 1"), labels.where("false")):
        model = module.fitted(odd, known, F.lit(True))
        found = module.scored(odd, model, ("doc_id", "text", "score"))
        rows = found.collect()
        assert found.columns == ["doc_id", "text", "score"] and len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r.text or "", r.score) == r.score
    assert module.scored(empty, model).count() == 0
    assert {round(r.score, 6) for r in module.scored(odd, module.fitted(empty, labels, F.lit(True))).collect()} == {0.0}
