import random

import pytest
import xxhash
from pyspark.sql import functions as F

from versewright.llm import simhash
from versewright.llm.common import components


def by_bits(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(ids, near):
    """Smallest id that links lead to, by walking."""
    out = {}
    for start in sorted(ids):
        if start not in out:
            todo = [start]
            while todo:
                i = todo.pop()
                if i not in out:
                    out[i] = start
                    todo += [j for j in ids if j not in out and near(i, j)]
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "A b c", "ÄB äb x\x1cy\tz  q", "x " * 999])
def test_fingerprint_by_bits(text, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    assert simhash.fingerprint((text or "").encode()) == by_bits(text)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(bucket)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for c in centres for _ in range(30)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    want = reached(signed, near)
    assert {f: got.get(f, f) for f in signed} == want
    assert len(set(want.values())) < len(fps)


def test_components_of_a_long_path(spark):
    rnd = random.Random(4)
    order = list(range(300))
    rnd.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}
    assert components(edges.where("false")).count() == 0


def test_documents_by_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=120)) for _ in range(20)]
    rows = []
    for i in range(80):
        own = texts[i % 20].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((i * 3, " ".join(own)))
    fps = {i: by_bits(t) for i, t in rows}
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fp"), "component_id").collect()
    assert {r.doc_id: r.fp for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    want = reached(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 11
    least = {(r.doc_id, r.fp): r.component_id for r in found}
    zero = [r.component_id for r in found if r.fp == 0]
    assert zero == [2, 2, 2]
    assert least[5, next(r.fp for r in found if r.doc_id == 5)] == 4
    assert [r.component_id for r in found if r.doc_id is None and r.fp] == [None]
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text is None, r.n_chars) for r in kept.collect()) == [
        (0, False, 12), (1, False, 11), (2, True, None), (4, False, 510_000), (6, False, 7), (7, False, 19), (7, False, 22)]
    assert simhash.near_duplicates(empty).count() == 0 == simhash.deduplicated(empty).count()
