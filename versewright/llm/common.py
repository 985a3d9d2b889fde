"""Helpers that the operators of this folder share: tables, keys, samples of labelled rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright.session import written

#: Texts turned into Python values at a time, so that a batch of long texts isn't held twice.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(column) -> Iterator:
    """The values of an Arrow column, a few rows at a time."""
    for start in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(start, ROWS_AT_ONCE).to_pylist()


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of any value, also of classes that workers can't import. ``of_worker`` opens it."""
    return spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(value)})


def of_worker(shared: Broadcast, make=None):
    """The value, opened (and turned into what ``make`` makes of it) once by each Python worker, not by each task."""
    held = shared.value
    if "pickled" in held:
        value = cloudpickle.loads(held.pop("pickled"))
        held["value"] = make(value) if make else value
    return held["value"]


def id_hash(doc_id: Column) -> Column:
    """CRC-32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """Texts with their label, stored: about ``per_class`` rows of each label value and at most twice as many.

    Rows are taken by a hash of their id, so that the same table gives the same sample; ``usable`` tells which ids may be
    learned from. Columns: ``doc_id, label, weight, text``; ``weight`` is how many labelled rows a row stands for. Only
    the sampled ids, bounded by ``per_class``, are broadcast; texts stay where they are.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & usable)
    rows = rows.where(F.col("label").isin(0, 1)).distinct()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for value, count in sorted(counts.items()):
        share = min(1.0, per_class / count)
        part = rows.where(F.col("label") == value)
        part = part.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        part = part.limit(2 * per_class).withColumn("weight", F.lit(1.0 / share))
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = rows.withColumn("weight", F.lit(1.0))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return written(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "weight", "text"), "sample")


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges (u, v)`` can reach: ``node, component``.

    Every round lets each node and the root of each node take the smallest label next to it, then jumps to the label of
    its label, so that rounds grow with the logarithm of the longest path. Labels are written once a round; what a
    round reads is a table, so that a hot node's edges can be split over tasks.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both.where(F.col("u") != F.col("v")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
        "node", F.least("node", "v").alias("label")), "labels")
    while True:
        ends = both.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u")
        ends = ends.join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        ends = ends.where("lu < lv")
        better = ends.select(F.explode(F.array("v", "lv")).alias("node"), F.col("lu").alias("near"))
        better = better.groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(better, "node", "left").select(
            "node", "label", F.coalesce(F.least("label", "near"), "label").alias("next"))
        hooked = written(hooked, "hooked")
        roots = hooked.select(F.col("node").alias("next"), F.col("next").alias("root"))
        labels = written(hooked.join(roots, "next").select(
            "node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("changed")
