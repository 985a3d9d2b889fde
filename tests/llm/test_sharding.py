import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewright.llm import sharding


def test_matrix_fits_both_margins():
    rnd = random.Random(1)
    for seed in range(30):
        rows = np.array([rnd.choice([0, 1, 7, 100]) for _ in range(rnd.randint(1, 9))])
        blocks = sharding.sizes_of(int(rows.sum()), rnd.randint(1, 12))
        table = np.array([sharding.matrix_row(p, rows, blocks, seed) for p in range(len(rows))])
        assert (table.sum(axis=0) == blocks).all() and (table.sum(axis=1) == rows).all() and (table >= 0).all()


def test_matrix_follows_the_law_of_a_permutation():
    rows, blocks, n = np.array([2, 3]), np.array([3, 2]), 6000
    got = Counter(int(sharding.matrix_row(0, rows, blocks, seed)[0]) for seed in range(n))
    law = {0: 1 / 10, 1: 6 / 10, 2: 3 / 10}
    assert all(abs(got[k] / n - p) < 0.03 for k, p in law.items())


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(sharding, "LARGE", 0)
    drawn = np.array([sharding.hypergeometric(rng, 40, 60, 30) for _ in range(20_000)])
    direct = rng.hypergeometric(40, 60, 30, 20_000)
    for k in range(6, 19):
        assert abs((drawn == k).mean() - (direct == k).mean()) < 0.015
    monkeypatch.undo()
    huge = [sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**10) for _ in range(300)]
    assert abs(np.mean(huge) - 2.5e9) < 2e4 and 3.0e4 < np.std(huge) < 5.5e4
    parts = sharding.split(rng, np.array([10**10, 0, 3 * 10**9, 5]), 10**9)
    assert parts.sum() == 10**9 and parts[1] == 0 and (parts >= 0).all()


@pytest.mark.parametrize("rows, parts", [(0, 3), (5, 3), (16, 16), (1000, 7), (5000, 1)])
def test_exact_sizes_and_slots(spark, rows, parts):
    d = spark.range(0, rows, 1, parts).select("id", F.repeat(F.lit("t"), (F.col("id") % 50).cast("int")).alias("text"))
    first = sorted(map(tuple, sharding.sharded(d, 16, stored=True).collect()))
    assert [r[:2] for r in first] == [(i, "t" * (i % 50)) for i in range(rows)]
    slots = {}
    for _, _, shard, slot in first:
        slots.setdefault(shard, []).append(slot)
    assert {s: sorted(x) for s, x in slots.items()} == {s: list(range(n)) for s, n in enumerate(sharding.sizes_of(rows, 16).tolist()) if n}
    assert sorted(map(tuple, sharding.sharded(d, 16, stored=True).collect())) == first
    assert [r[:2] for r in sorted(map(tuple, sharding.sharded(d, 16).collect()))] == [r[:2] for r in first]
    if rows == 1000:
        assert sorted(map(tuple, sharding.sharded(d, 16, seed=1, stored=True).collect())) != first


def test_all_orders_are_equally_likely(spark):
    orders = Counter()
    for seed in range(240):
        rows = np.array([2, 1])
        blocks = sharding.sizes_of(3, 1)
        labels = [sharding.matrix_row(p, rows, blocks, seed) for p in range(2)]
        assert sum(x.sum() for x in labels) == 3
        order = np.random.default_rng((seed, 2, 0)).permutation(3)
        orders[tuple(order.tolist())] += 1
    assert set(orders) == set(permutations(range(3))) and max(orders.values()) < 75


def test_odd_rows(odd, empty):
    found = sharding.sharded(odd, 3)
    assert found.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = found.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 4, 4]
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert sharding.sharded(empty, 3).count() == 0


def test_changed_partitions_stop_the_job(spark):
    deal = sharding._dealer(np.array([3]), np.array([3]), 1)
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 0)

    from unittest.mock import patch

    for n in (2, 4):
        batch = pa.RecordBatch.from_pydict({"x": list(range(n))})
        with patch.object(sharding.TaskContext, "get", staticmethod(lambda: Context)), pytest.raises(RuntimeError):
            list(deal(iter([batch])))
