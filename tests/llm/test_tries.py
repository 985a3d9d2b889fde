import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versewright.llm import queries, tries

ROWS = "conv_id long, turn long, role string, text string"


def nodes_of(conversations):
    """The trie by gathering the members of each prefix."""
    members = {}
    for conv_id, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv_id)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    out = set()
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in members)]
        ends = ",".join(map(str, sorted(c for c in own if len(conversations[c]) == len(path))))
        out.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), len(leaves),
                 sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(rows):
    """Turns in order, null first, equal numbers by digest."""
    by = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by.setdefault(conv_id, []).append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(turns)] for c, turns in by.items()}


def found_of(df):
    return {tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def random_rows(seed, convs=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(-5, convs):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([t, t, None]) if rnd.random() < 0.1 else t, rnd.choice(["user", "assistant", None]),
                         rnd.choice(["a", "a b", "a  b\tc", "", None, "é"]) if t else rnd.choice(["hello", "hello you"])))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_nodes_are_those_of_gathering(spark, shards):
    rows = random_rows(shards)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        df = spark.createDataFrame(rows, ROWS)
        assert found_of(tries.nodes(tries.paths(df))) == nodes_of(turns_of(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lists_of_ends_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 3)
    rows = [(b"a", i) for i in range(-4, 10)] + [(b"b", 5)] + [(b"c", 10 ** 12), (b"c", 10 ** 13)]
    batches = (pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i])], ["key", "conv_id"]) for k, i in rows)
    found = {r["key"]: r["ends_sha256"] for b in tries._hashed(tries._pieces(batches)) for r in b.to_pylist()}
    want = {k: ",".join(str(i) for key, i in rows if key == k) for k, _ in rows}
    assert found == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_short_splitters(spark, monkeypatch):
    rows = random_rows(9) + [(1000 + c, t, "user", "same") for c in range(40) for t in range(6)]
    monkeypatch.setattr(tries, "MOST_TURNS", 2)
    assert found_of(tries.nodes(tries.paths(spark.createDataFrame(rows, ROWS)))) == nodes_of(turns_of(rows))


def test_registered_query_rebuilds(spark, tmp_path):
    rows = random_rows(2) + [(None, 1, "user", "left out"), (40, 3, None, None), (40, 3, None, None)]
    rows = [r for r in rows if r[0] != 60]  # no base for 60 to 79
    spark.createDataFrame(rows, ROWS).withColumn("words", F.lit("clash")).withColumn("path", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    own, rebuilt = turns_of(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not turns for turns in rebuilt.values())  # turnless ones end at the root
    assert found_of(queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path))) == nodes_of(rebuilt)


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert tries.nodes(tries.paths(spark.createDataFrame(rows, ROWS))).count() == 0


def test_very_long_and_equal_conversations(spark):
    deep = [(c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(3000)]
    found = tries.nodes(tries.paths(spark.createDataFrame(deep, ROWS)))
    last = found.where("depth = 3000").first()
    assert found.count() == 3001 and (last.conv_id, last.n_convs, last.n_leaves) == (1, 3, 1)
    assert last.ends_sha256 == hashlib.sha256(b"1,2,3").hexdigest()
    assert found.where("depth = 0").first().saved_tokens == 3000 * 2 * 2
