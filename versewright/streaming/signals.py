"""Detections of a running search: correlation, ordering, stopped runs and reloads.  Batch and streaming alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rects
from ..operators import ocr
from ..operators.skew import attach


def detections(
    dwells: DataFrame, windows: DataFrame, words: DataFrame, chapters: DataFrame, lang: str = "de", vers_name: str = "esv"
) -> DataFrame:
    """``search_id, ranges, box`` of the resting points with references under them, boxes on the screen.

    ``dwells``: ``key, image_id, search_id, x, y``; ``windows``: ``image_id, origin_x, origin_y``.  Resting points
    without references drop out, ranges are sorted by begin.
    """
    at = attach(dwells.select("image_id", "search_id", "x", "y"), windows, ["image_id"])
    searches = at.select(
        "image_id", "search_id", (F.col("x") - F.col("origin_x")).cast("int").alias("x"),
        (F.col("y") - F.col("origin_y")).cast("int").alias("y"),
    )
    found = ocr.find_references(words, searches, chapters, lang, vers_name)
    d = found.join(at.select("search_id", "origin_x", "origin_y"), "search_id")
    return d.select("search_id", "ranges", rects.shifted(F.col("box"), F.col("origin_x"), F.col("origin_y")).alias("box"))


def correlate(detected: DataFrame, detecting: DataFrame) -> DataFrame:
    """Each detection with the signal that started it by ``detection_id``; one without keeps nulls to fall back on."""
    return detected.join(detecting, "detection_id", "left")


def correlate_streams(detected: DataFrame, detecting: DataFrame, lateness: str) -> DataFrame:
    """:func:`correlate` of two streams ``detection_id, detected_at`` and ``detection_id, detecting_at``.

    A search finishes within the lateness; after that the unmatched side is given out or dropped from the state.
    """
    left = detected.withWatermark("detected_at", lateness)
    right = detecting.withWatermark("detecting_at", lateness).withColumnRenamed("detection_id", "__id")
    close = (F.col("detection_id") == F.col("__id")) & (F.col("detecting_at") <= F.col("detected_at")) & (
        F.col("detecting_at") >= F.col("detected_at") - F.expr(f"interval {lateness}")
    )
    return left.join(right, close, "left_outer").drop("__id")


def latest(results: DataFrame, keys: list[str], started: str = "started_at") -> DataFrame:
    """Per key the result of the search started last; an older one is dropped.  A plain aggregation, also streaming."""
    values = [c for c in results.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.col(started))
    return results.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def of_running(results: DataFrame, runs: DataFrame, at: str = "ts") -> DataFrame:
    """Results ``process_id, ts`` of runs ``process_id, stopped_at`` that were not stopped before."""
    d = attach(results, runs.select("process_id", "stopped_at"), ["process_id"], "left")
    return d.where(F.col("stopped_at").isNull() | (F.col(at) < F.col("stopped_at"))).drop("stopped_at")


def watch_folder(
    spark: SparkSession, folder: str, store: str, checkpoint: str, every: str = "30 seconds", reader: Callable | None = None
):
    """Compare a scripture folder with the store again and again and load what is new, was replaced or has vanished.

    A micro-batch lists the folder; only archives whose size or time differ from the store's manifest are read. A batch in
    which nothing differs makes no version, one that fails is repeated and leaves the version before it whole.
    """
    from ..sources import archives

    options = {"reader": reader} if reader else {}
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(
        lambda batch, _: archives.load(spark, folder, store, **options) and None
    )
