import pickle
import random

import numpy as np
import pytest

from versewright.llm import decontaminate as d

WORDS = [f"w{i}" for i in range(300)]


def sentence(rnd, n):
    return " ".join(rnd.choices(WORDS, weights=[1 / (i + 1) for i in range(300)], k=n)).capitalize() + "."


def bm25(words, items):
    """Score of every item by the formula, as a share of its own."""
    split = [d.words_of(t) for t in items]
    average = sum(map(len, split)) / len(split)
    out = []
    for own in split:
        def weight(w, own=own):
            n = sum(w in x for x in split)
            tf = own.count(w)
            return np.log(1 + (len(items) - n + 0.5) / (n + 0.5)) * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(own) / average))

        out.append(sum(weight(w) for w in set(own) & set(words)) / sum(weight(w) for w in set(own)))
    return out


def index_of(items):
    split = [set(d.words_of(t)) for t in items]
    frequency = {w: sum(w in x for x in split) for w in set().union(*split)}
    average = sum(len(d.words_of(t)) for t in items) / len(items)
    return d.build(list(enumerate(items)), len(items), frequency, average)


@pytest.mark.parametrize("least", [0.2, 0.35, 0.6])
def test_wand_by_brute_force(least):
    rnd = random.Random(int(least * 100))
    items = [sentence(rnd, rnd.randint(8, 40)) for _ in range(90)]
    index = index_of(items)
    for _ in range(60):
        words = d.words_of(" ".join(sentence(rnd, rnd.randint(5, 60)) for _ in range(2)) + rnd.choice(items))
        want = {i for i, s in enumerate(bm25(words, items)) if s >= least}
        numbers = np.array(sorted({index.terms[w] for w in words if w in index.terms}))
        got = dict(index.wand(numbers, least))
        assert set(got) == want
        found = {item for _, _, item, _ in index.search(words, least)}
        if len(words) <= 2 * index.longest:
            assert found == want
        else:
            assert found <= want


def test_every_place_lies_in_a_passage():
    text = "one two three four five six seven"
    index = index_of([text])
    for n in (0, 1, 50, 57, 58, 63, 64, 65, 120, 128, 129, 200):
        for at in range(n + 1):
            words = ["x"] * n
            words[at:at] = text.split()
            spans = [(a, b) for a, b, _, _ in index.search(words, 0.99)]
            assert any(a <= at and at + 7 <= b for a, b in spans)
            assert all(a == 0 or b - a == 2 * index.longest for a, b in spans)


def test_leaks_are_found_and_others_left(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choices(names, k=rnd.randint(5, 50))) + ". " + " ".join(rnd.choices(names, k=3))) for i in range(40)]
    items += [(40, " ".join(rnd.choices(names, k=300)) + "."), (41, items[3][1])]
    docs, want = [], set()
    for i in range(200):
        words = rnd.choices(names, k=rnd.randint(0, 700))
        if i % 4 == 0:
            k = rnd.randrange(42)
            at = rnd.randint(0, len(words))
            words[at:at] = items[k][1].upper().split()
            want |= {(i, k)} | ({(i, 3), (i, 41)} if k in (3, 41) else set())
        elif i % 4 == 1:  # the question without the answer, half of an item, all words in another order
            k = rnd.randrange(40)
            own = items[k][1].split()
            words += rnd.choice([own[:-3] + ["other", "end", "words"], own[:len(own) // 2], sorted(own)])
        docs.append((i, " ".join(words)))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, x.item_id) for r in d.contaminated(docs, items).collect() for x in r.leaks}
    assert got == want
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == sorted(set(range(200)) - {i for i, _ in want})


def test_many_groups_of_indexes(spark, monkeypatch):
    monkeypatch.setattr(d, "POSTINGS", 30)
    rnd = random.Random(8)
    items = [(i, sentence(rnd, 15)) for i in range(12)]
    docs = [(i, f"{sentence(rnd, 20)} {t}") for i, t in items] + [(99, sentence(rnd, 30))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, x.item_id) for r in d.contaminated(docs, items).collect() for x in r.leaks} == {(i, i) for i in range(12)}
    assert [(r.doc_id, r.text[:1] != "") for r in d.clean(docs, items).collect()] == [(99, True)]


def test_long_documents_in_steps(monkeypatch):
    monkeypatch.setattr(d, "STEP_WORDS", 64)
    index = index_of(["alpha beta gamma delta epsilon zeta. eta theta"])
    for at in range(480, 560):
        words = ["x"] * 1100
        words[at:at] = d.words_of("alpha beta gamma delta epsilon zeta. eta theta")
        assert [x[0] for x in d.leaks(" ".join(words), [index], 0.5, 0.8)] == [0]


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "no id at all"), (5, "wide river stone wide river stone"), (None, "a lone line"), (4, "no id at all")], "item_id long, text string")
    found = d.contaminated(odd, items, ("doc_id", "leaks", "score"))
    assert found.columns == ["doc_id", "score", "leaks"]
    got = sorted((r.doc_id or 0, [x.item_id for x in r.leaks]) for r in found.collect())
    assert got == [(0, []), (0, [4]), (1, [None]), (1, [None]), (2, []), (3, []), (4, [5]), (5, [5]), (6, []), (7, []), (7, [])]
    kept = d.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == 6
    assert d.clean(odd, items.where("false")).count() == 11
    assert d.contaminated(empty, items).count() == 0


def test_an_index_grows_with_its_postings():
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(1000)]
    index = d.build(items, 1000, {w: 1 for _, t in items for w in t.split()}, 30.0)
    assert len(pickle.dumps(index)) < 20_000_000
    assert [x[0] for x in d.leaks("and then " + items[777][1] + " so", [index], 0.5, 0.8)] == [777]
