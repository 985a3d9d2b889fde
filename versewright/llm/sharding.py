"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each block of a shard follows the law that a uniform permutation of all rows
gives: a table with the partitions' and the blocks' sizes as its margins. A task draws its own row of the table: it goes
down a binary tree over the partitions, at each node splitting the blocks' sizes between both halves by a multivariate
hypergeometric draw that is seeded by the node, so that all tasks draw from the same table and none holds it whole. Rows
are permuted within the partition by dealing them shuffled block numbers, exchanged by block, and permuted again within
the block, in the order of partition and place, so that a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewright.session import written

#: Blocks for each shuffle partition, so that hashing spreads them evenly.
BLOCKS_PER_PARTITION = 4
#: Populations of fewer rows than this are drawn by numpy.
LARGE = 10**9

_BLOCK, _SOURCE, _PLACE = "__shard_block", "__shard_source", "__shard_place"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn from ``good + bad`` are good.

    Beyond what numpy takes, by inversion over the values within twelve standard deviations, whose probabilities follow
    from the ratio of neighbours; what lies beyond is rarer than the resolution of the random number.
    """
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mean = sample * (good / total)
    spread = (mean * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    low = max(0, sample - bad, int(mean - 12 * spread) - 60)
    high = min(sample, good, int(mean + 12 * spread) + 60)
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1))))
    odds = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))


def split(rng: np.random.Generator, sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows come from each of the groups with these sizes."""
    total = int(sizes.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(sizes, sample, method="marginals")
    if len(sizes) == 1:
        return np.array([sample])
    half = len(sizes) // 2
    left = int(sizes[:half].sum())
    k = hypergeometric(rng, left, total - left, sample)
    return np.concatenate((split(rng, sizes[:half], k), split(rng, sizes[half:], sample - k)))


def matrix_row(part: int, rows: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """How many rows input partition ``part`` sends to each block. All rows of the table together fit both margins."""
    low, high, sizes = 0, len(rows), blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng((seed, 0, low, high)), sizes, int(rows[low:middle].sum()))
        if part < middle:
            high, sizes = middle, left
        else:
            low, sizes = middle, sizes - left
    return sizes


def sizes_of(rows: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most, the larger ones first."""
    return rows // parts + (np.arange(parts) < rows % parts).astype(np.int64)


def _dealer(rows: np.ndarray, blocks: np.ndarray, seed: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own_row = matrix_row(part, rows, blocks, seed) if part < len(rows) else np.zeros_like(blocks)
        labels = np.repeat(np.arange(len(blocks), dtype=np.int32), own_row)
        np.random.default_rng((seed, 1, part)).shuffle(labels)
        done = 0
        for batch in batches:
            own = labels[done:done + batch.num_rows]
            if len(own) < batch.num_rows:
                raise RuntimeError("the input's partitions have changed since they were counted")
            places = np.arange(done, done + len(own))
            done += len(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(np.full(len(own), part, np.int32)), pa.array(places)],
                [*batch.schema.names, _BLOCK, _SOURCE, _PLACE])
        if done < len(labels):
            raise RuntimeError("the input's partitions have changed since they were counted")

    return deal


def _placer(blocks: np.ndarray, starts: np.ndarray, per_shard: int, shards: int, seed: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, order = -1, 0, np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(_BLOCK)).to_numpy()
            slots = np.empty(len(own), np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if own[a] != block:
                    if done < len(order):
                        raise RuntimeError("rows of a block are missing")
                    block, done = int(own[a]), 0
                    order = np.random.default_rng((seed, 2, block)).permutation(int(blocks[block]))
                slots[a:b] = starts[block] + order[done:done + b - a]
                done += b - a
            keep = [c for c in batch.schema.names if c not in (_BLOCK, _SOURCE, _PLACE)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array((own // per_shard).astype(np.int32)), pa.array(slots)],
                [*keep, "shard", "slot"])
        if done < len(order):
            raise RuntimeError("rows of a block are missing")

    return place


def sharded(rows: DataFrame, shards: int = 16, seed: int = 20, stored: bool = False) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform permutation cut into ``shards`` of sizes that differ by one at most.

    ``slot`` numbers the rows of a shard from 0 without gaps; sort by it within a shard to read the shuffled order. Nulls,
    texts of any length and repeated rows are rows like any other; an empty table gives an empty one; with fewer rows than
    shards the last shards are empty. Columns named ``shard`` or ``slot`` are replaced. Partitions are read twice, once to
    count them, and must hold the same rows in the same order each time. A table just read from files does (``stored``);
    any other input is written first. A partition that differs from its count stops the job.
    """
    rows = rows.drop("shard", "slot")
    if not stored:
        rows = written(rows, "to-shard")
    spark = rows.sparkSession
    found = {r["part"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = -(-BLOCKS_PER_PARTITION * partitions // shards)
    per_shard = max(1, min(per_shard, total // shards))
    shard_sizes = sizes_of(total, shards)
    blocks = np.concatenate([sizes_of(int(n), per_shard) for n in shard_sizes])
    starts = (blocks.reshape(shards, per_shard).cumsum(axis=1) - blocks.reshape(shards, per_shard)).ravel()
    dealt = T.StructType([*rows.schema.fields, T.StructField(_BLOCK, T.IntegerType()), T.StructField(_SOURCE, T.IntegerType()), T.StructField(_PLACE, T.LongType())])
    placed = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = rows.mapInArrow(_dealer(counts, blocks, seed), dealt)
    out = out.repartition(_BLOCK).sortWithinPartitions(_BLOCK, _SOURCE, _PLACE)
    return out.mapInArrow(_placer(blocks, starts, per_shard, shards, seed), placed)
