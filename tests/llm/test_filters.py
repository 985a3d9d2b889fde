import glob
import hashlib
import os
import random
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from versewright.llm import filters

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def fails_of(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in text.encode().split()]
        out.append({
            *("A" if len(words) < 200 else ""), *("B" if 100 * len(set(words)) < 50 * len(words) else ""),
            *("C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""), *("D" if set(text) & set("#$%&*|") else ""),
            *("E" if doc_id is not None and text in first and doc_id > first[text] else "")})
    return out


def audited(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in range(2))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails_of(rows)) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                gone = [bool(f & set(order[:step - 1])) for _, f in own]
                here = [d for (d, f), g in zip(own, gone) if x in f and not g]
                out[part, order, step] = [
                    sum(not f & set(order[:step]) for _, f in own), len(here), sum(x in f and g for (_, f), g in zip(own, gone)),
                    sum(f == {x} for _, f in own), sum(d in good for d in here), sum(d in toxic for d in here), 0]
    for (part, order, step), v in out.items():
        v[6] = sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == order[step - 1])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, n)))
    texts = [" ".join(word(9) for _ in range(rnd.choice([3, 150, 199, 200, 260]))) for _ in range(30)]
    texts += ["A " * 250, "a b " * 100, "x # y", " wide space", "Tab\tnew\nline\x0bx\x1cy", None, "", "ÄÖ" * 40, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96]
    out = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    out += [(100 + i, t, rnd.choice(["en", "fr"])) for i, t in enumerate(texts[::2])]
    return out + [(3, texts[3], "en"), (3, texts[4], "en"), (None, texts[0], "en"), (None, None, None)]


def test_audit_is_that_of_applying_the_filters(spark, rows):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, 1), (102, 1, 1), (103, 1, 1), (None, 1, 1), (3, 1, 0), (999, 1, 1)]
    labels = labels + labels[:3]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("words", "part", "fails", "shard", "good", "quality")})
    found = filters.audit(docs, spark.createDataFrame(labels, LABELS))
    got = {(r.part, r.filter_order, r.step): tuple(r)[2:] for r in found.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    want = audited(rows, labels)
    assert {k: v[1:] for k, v in got.items()} == want and len(want) == 600 * 4


def test_matrix_counts_words(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    seen, meaning = {}, {}
    words = {(r[0], r[1]): (r[1] or "").encode().split() for r in rows}
    shards = filters.matrix(docs).collect()
    for s in shards:
        starts = np.array(s.starts)
        assert len(starts) == len(s.rows) + 1 and starts[-1] == len(s.columns) == len(s.counts)
        for k, r in enumerate(s.rows):
            own = dict(zip(s.columns[starts[k]:starts[k + 1]], s.counts[starts[k]:starts[k + 1]]))
            seen.setdefault(bytes(r.digest), []).append(own)
    for text in words.values():
        counts = {}
        for w in text:
            counts[w] = counts.get(w, 0) + 1
    for (_, text), tokens in words.items():
        for own in seen[hashlib.sha256((text or "").encode()).digest()]:
            assert sum(own.values()) == len(tokens) and len(own) == len(set(tokens))
            meaning.setdefault(frozenset(own.items()), set()).add(frozenset((w, tokens.count(w)) for w in tokens))
    assert all(len(m) == 1 for m in meaning.values())
    vocabulary = {w for tokens in words.values() for w in tokens}
    assert len({n for s in shards for n in s.columns}) == len(vocabulary)


def test_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    found = filters.audit(odd, labels)
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    want = audited(rows, [(1, 1, 1)])
    assert {(r.part, r.filter_order, r.step): r.removed for r in found.collect()} == {k: v[1] for k, v in want.items()}
    assert filters.audit(empty, labels).count() == 0
    assert filters.audit(odd, labels.where("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_tables_of_shards_are_read_a_few_rows_at_a_time(spark):
    text = F.expr("array_join(transform(sequence(1, 300000), i -> hex(hash(id, i))), ' ')")
    docs = spark.range(16).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    old = set(glob.glob(f"{shared}/shards-*"))
    assert filters.matrix(docs, sums=True).where("words = 300000").count() == 16
    (made,) = set(glob.glob(f"{shared}/shards-*")) - old
    groups = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in glob.glob(os.path.join(made, "*.parquet"))
              for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) >= 4 and max(groups) <= 2, groups
