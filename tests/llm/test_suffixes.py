import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewright.llm import induced, suffixes

DOCS = "doc_id long, text string"


def in_order(symbols):
    """All suffixes sorted by comparing them, and what neighbours share."""
    text = list(symbols)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    return order, shared


def texts(rnd):
    for kind in range(60):
        n, wide = rnd.randint(0, 200), rnd.choice([1, 2, 3, 26])
        if kind % 3 == 0:
            text = [rnd.randint(1, wide) for _ in range(n)]
        elif kind % 3 == 1:  # periods, with a few other symbols
            period = [rnd.randint(1, wide) for _ in range(rnd.randint(1, 6))]
            text = (period * n)[:n]
            for _ in range(rnd.randint(0, 3) if n else 0):
                text[rnd.randrange(n)] = rnd.randint(1, wide)
        else:  # runs
            text = [s for _ in range(n // 4) for s in [rnd.randint(1, wide)] * rnd.randint(1, 7)]
        yield np.array([*text, 0], np.int32), wide + 1


@pytest.mark.parametrize("on_disk", [False, True])
def test_suffix_order_is_that_of_comparison(monkeypatch, on_disk):
    """Also with everything on disk, blocks and ranges of a few entries and recursion down to the last star."""
    if on_disk:
        for name, value in (("IN_MEMORY", 0), ("BLOCK", 32), ("RANGE", 4), ("DOUBLED", 4)):
            monkeypatch.setattr(induced, name, value)
    for text, symbols in texts(random.Random(on_disk)):
        order, shared = induced.suffix_order(text, symbols)
        assert (list(order), list(shared)) == in_order(text.tolist())


def test_ranges_of_minima():
    rnd = np.random.default_rng(1)
    of = rnd.integers(0, 1000, 700).astype(np.int32)
    least = induced.RangeMin(of)
    a, b = np.sort(rnd.integers(0, 700, (2, 3000)), axis=0)
    assert least(a, b).tolist() == [of[i:j + 1].min() for i, j in zip(a, b)]


def removed(rows, window):
    """By comparing all windows: bytes, removed bytes, spans and digest of what stays, row by row."""
    rows = [(text or "").encode() for text in rows]
    seen = {}
    for text in rows:
        for i in range(len(text) - window + 1):
            seen[text[i:i + window]] = seen.get(text[i:i + window], 0) + 1
    for text in rows:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - window + 1):
            if seen[text[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        yield len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def compared(spark, rows, window=suffixes.WINDOW):
    rows = [(i, text) for i, text in enumerate(rows)]
    found = suffixes.repeats(spark.createDataFrame(rows, DOCS), window).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == list(removed([t for _, t in rows], window))
    return found


def test_passages_anywhere(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(60), "x" * 90 + prose(10)
    rows = [prose(80), prose(20) + long + prose(30), long, prose(3) + long[3:-2] + prose(3), prose(9) + short + prose(9) + short,
            long + "|" + long, "ab" * 400, "-" * 700, None, "", prose(1), prose(80) + long[:150]]
    rows += [rows[0]] * 3 + [rows[7]] + [prose(200)[:4000] + long[k:] for k in range(0, 300, 40)]
    found = compared(spark, rows)
    assert found[0].n_removed == found[0].n_bytes > 0 and found[2].n_removed == found[2].n_bytes
    assert [s.stop - s.start for s in found[7].spans] == [700]


def test_pieces_and_shards_make_no_difference(spark, monkeypatch):
    rnd = random.Random(5)
    block = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(50, 400))) for _ in range(40)]
    rows = ["".join(rnd.choices(block, k=rnd.randint(1, 9))) for _ in range(60)]
    compared(spark, rows)
    compared(spark, rows, 100)
    # The number of shards is set where the plan is made.
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 5_000)
    compared(spark, rows)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abc") for _ in range(5000)).encode()
    monkeypatch.setattr(suffixes, "PIECE", 700)
    anchor, first, count = suffixes.segments(text)
    assert first.tolist() == [0, *np.cumsum(count)[:-1]] and count.sum() == len(text) - suffixes.WINDOW + 1


def test_odd_rows(odd, empty):
    found = suffixes.repeats(odd)
    rows = [r.asDict() for r in found.collect()]
    assert len(rows) == odd.count()
    by_text = {r["doc_id"]: r for r in rows if r["doc_id"] in (4, 5)}
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in by_text.values())
    assert all(r["n_removed"] == 0 for r in rows if r["n_bytes"] < suffixes.WINDOW)
    assert suffixes.repeats(empty).count() == 0


def test_registered_query_is_brute_force(spark):
    from versewright.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: row for d, row in zip(docs, removed([d.text for d in docs], suffixes.WINDOW))}
    found = queries.QUERIES["op11_suffix_array_dedup"](spark, folder)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert found.where(F.col("n_removed") > 0).count() > 0
