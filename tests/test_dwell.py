import math
import random

import pytest
from pyspark.sql import functions as F

from versewright.streaming import dwell


def drift(seed, n, step, poll=60):
    """A cursor that drifts in small steps, now and then rests or jumps."""
    rnd, x, y, out = random.Random(seed), 0.0, 0.0, []
    for i in range(n):
        if rnd.random() < 0.002:
            x, y = x + rnd.uniform(-90, 90), y + rnd.uniform(-90, 90)
        elif (i // 97) % 3:
            x, y = x + rnd.uniform(-step, step), y + rnd.uniform(-step, step)
        out.append((i * poll + rnd.randint(0, 20), round(x, 2), round(y, 2)))
    return out


def plainly(rows, dwell_ms=700, tolerance=8.0):
    return [(k, *f) for k in sorted({r[0] for r in rows}) for f in dwell.plain(
        sorted(r[1:] for r in rows if r[0] == k), dwell.Rest(), dwell_ms, tolerance)]


@pytest.mark.parametrize("bucket_ms", [200, 1500, 20_000, 3_600_000])
def test_buckets_make_no_difference(spark, bucket_ms):
    rows = [(key, *s) for seed, key in enumerate("abc") for s in drift(seed, 1500, 3.0)]
    rows += [("rest", i * 100, 5.0, 5.0) for i in range(600)]  # one spot through all buckets fires once
    rows += [("once", 7, 1.0, 1.0), ("tie", 5, 1.0, 1.0), ("tie", 5, 1.0, 1.0), ("tie", 900, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "key string, ts long, x double, y double")
    found = dwell.dwells(d, bucket_ms=bucket_ms).orderBy("key", "ts", "x", "y").collect()
    assert list(map(tuple, found)) == plainly(rows)
    assert sum(r.key == "rest" for r in found) == 1


def test_a_key_without_jumps_is_spread(spark, monkeypatch):
    """Smooth motion that no bucket's end forgets for certain; tasks see buckets, not the key."""
    rows = [("hot", i * 50, 4.0 * math.sin(i / 300) * i / 400, i / 25) for i in range(20_000)]
    d = spark.createDataFrame(rows, "key string, ts long, x double, y double")
    assert list(map(tuple, dwell.dwells(d, bucket_ms=10_000).orderBy("ts").collect())) == plainly(rows)
    one = d.repartition(8, "key", F.floor(F.col("ts") / 10_000))
    assert one.groupBy(F.spark_partition_id()).count().count() == 8


def test_rows_without_a_time_or_place_are_left_out(spark):
    rows = [("a", None, 1.0, 1.0), ("a", 0, None, 1.0), ("a", 0, 1.0, 1.0), ("a", 800, 1.0, 1.0), (None, 0, 1.0, 1.0), (None, 900, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "key string, ts long, x double, y double")
    assert {(r.key, r.ts) for r in dwell.dwells(d).collect()} == {("a", 800), (None, 900)}
    assert dwell.dwells(d.where("false")).count() == 0
