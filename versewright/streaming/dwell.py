"""Resting points in streams of cursor samples.

A cursor rests once it stays within a tolerance of an anchor for the dwell time; it fires once per spot and re-arms
after leaving it.  That is a sequential fold per key.  The batch job folds buckets of time by themselves and then only
those again that start otherwise than was assumed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import written

BUCKET_MS = 3_600_000
#: Buckets with so many samples at most carry them along, so that they are folded where the state is carried.
FEW = 8
FIRED = "key string, ts long, x double, y double, anchor_x double, anchor_y double, since long"
_FIRING = ["ts", "x", "y", "anchor_x", "anchor_y", "since"]
_STATE = "struct<ax: double, ay: double, since: bigint, ex: double, ey: double>"
_BUCKET = (
    f"key string, bucket long, start {_STATE}, end {_STATE}, left double, right double, top double, bottom double, "
    "fired array<struct<ts: bigint, x: double, y: double, anchor_x: double, anchor_y: double, since: bigint>>, "
    "few array<struct<ts: bigint, x: double, y: double>>"
)
_STATE_TYPE = pa.struct([("ax", pa.float64()), ("ay", pa.float64()), ("since", pa.int64()), ("ex", pa.float64()), ("ey", pa.float64())])
_SAMPLE_TYPE = [("ts", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]
_BUCKET_TYPE = pa.schema([
    ("key", pa.string()), ("bucket", pa.int64()), ("start", _STATE_TYPE), ("end", _STATE_TYPE),
    *((c, pa.float64()) for c in ("left", "right", "top", "bottom")),
    ("fired", pa.list_(pa.struct([*_SAMPLE_TYPE, ("anchor_x", pa.float64()), ("anchor_y", pa.float64()), ("since", pa.int64())]))),
    ("few", pa.list_(pa.struct(_SAMPLE_TYPE)))])
_CARRIED_TYPE = _BUCKET_TYPE.append(pa.field("again", pa.bool_()))
STATE = "ax double, ay double, since long, ex double, ey double"


def limits(poll_ms: int = fixed.POLL_MS, dwell_ms: int = fixed.DWELL_MS, tolerance: float = fixed.TOLERANCE_PX):
    """Settings raised to their floors."""
    return (
        max(poll_ms, fixed.MIN_POLL_MS), max(dwell_ms, fixed.MIN_DWELL_MS), max(tolerance, fixed.MIN_TOLERANCE_PX)
    )


def sampled(samples: DataFrame, poll_ms: int = fixed.POLL_MS) -> DataFrame:
    """The first of the samples ``key, ts, x, y`` of every poll interval; ``ts`` in milliseconds.

    Partial minima are taken before the shuffle, so a busy key costs one row per interval and task.
    """
    first = F.min_by(F.struct("x", "y"), F.struct("ts", "x", "y"))
    slot = F.floor(F.col("ts") / F.lit(max(poll_ms, fixed.MIN_POLL_MS))).alias("slot")
    return samples.groupBy("key", slot).agg(F.min("ts").alias("ts"), first.alias("p")).select("key", "ts", "p.x", "p.y")


class Rest:
    """State of one key: the anchor, the time it was taken and the spot last examined."""

    __slots__ = ("anchor", "since", "examined")

    def __init__(self, anchor=None, since=0, examined=None):
        self.anchor, self.since, self.examined = anchor, since, examined

    def advance(self, ts: int, x: float, y: float, dwell: int, tolerance: float) -> bool:
        """Take a sample; whether it fires."""
        away = lambda p: math.hypot(p[0] - x, p[1] - y) > tolerance
        if self.anchor is None or away(self.anchor):
            self.anchor, self.since = (x, y), ts
        if self.examined is not None and away(self.examined):
            self.examined = None
        if self.examined is None and ts - self.since >= dwell:
            self.examined = self.anchor
            return True
        return False

    def stays(self, box: dict, tolerance: float) -> bool:
        """Whether it's sure that no sample within a box changes anything: the spot is examined and not left."""
        if self.examined is None:
            return False
        far = lambda p: math.hypot(max(p[0] - box["left"], box["right"] - p[0]), max(p[1] - box["top"], box["bottom"] - p[1]))
        return far(self.anchor) <= tolerance and far(self.examined) <= tolerance

    @classmethod
    def of(cls, state: dict | None) -> Rest:
        if state is None:
            return cls()
        examined = None if state["ex"] is None else (state["ex"], state["ey"])
        return cls((state["ax"], state["ay"]), state["since"], examined)

    def as_dict(self) -> dict:
        ex, ey = self.examined or (None, None)
        return {"ax": self.anchor[0], "ay": self.anchor[1], "since": self.since, "ex": ex, "ey": ey}


def plain(samples: Iterable[tuple[int, float, float]], rest: Rest, dwell: int, tolerance: float) -> list[tuple]:
    """Fold sorted samples ``ts, x, y``: what fires, as ``ts, x, y, anchor_x, anchor_y, since``."""
    fired = []
    for ts, x, y in samples:
        if rest.advance(ts, x, y, dwell, tolerance):
            fired.append((ts, x, y, *rest.anchor, rest.since))
    return fired


def _folder(dwell: int, tolerance: float):
    """Folds each bucket of rows sorted by key, bucket and time from its ``start``."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rest, row, out = None, None, None, []

        def close() -> None:
            if row is not None:
                row["end"] = rest.as_dict()
                out.append(row)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "bucket", "ts", "x", "y", "start"))
            for key, bucket, ts, x, y, start in zip(*columns):
                if (key, bucket) != current:
                    close()
                    current, rest = (key, bucket), Rest.of(start)
                    row = {"key": key, "bucket": bucket, "start": start, "left": x, "right": x, "top": y, "bottom": y, "fired": [], "few": []}
                row["left"], row["right"] = min(row["left"], x), max(row["right"], x)
                row["top"], row["bottom"] = min(row["top"], y), max(row["bottom"], y)
                if row["few"] is not None:
                    row["few"] = [*row["few"], {"ts": ts, "x": x, "y": y}] if len(row["few"]) < FEW else None
                row["fired"] += [dict(zip(_FIRING, f)) for f in plain([(ts, x, y)], rest, dwell, tolerance)]
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, _BUCKET_TYPE)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _BUCKET_TYPE)

    return fold


def _carrier(dwell: int, tolerance: float):
    """Carries the state along the buckets of each key, sorted by key and bucket; gives the rows that this changes.

    A bucket with few samples is folded here. One that a resting cursor doesn't leave passes the state on. Any other whose
    start differs has to be folded again (``again``); until then its old end stands for the new one.
    """
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != current:
                    current, state = row["key"], None
                same = row["start"] == state
                if not same:
                    row |= {"start": state, "again": False}
                    rest = Rest.of(state)
                    if row["few"] is not None:
                        found = plain([(s["ts"], s["x"], s["y"]) for s in row["few"]], rest, dwell, tolerance)
                        row |= {"fired": [dict(zip(_FIRING, f)) for f in found], "end": rest.as_dict()}
                    elif rest.stays(row, tolerance):
                        row |= {"fired": [], "end": state}
                    else:
                        row["again"] = True
                    out.append(row)
                state = row["end"]
            yield pa.RecordBatch.from_pylist(out, _CARRIED_TYPE)

    return carry


def dwells(
    samples: DataFrame, dwell_ms: int = fixed.DWELL_MS, tolerance: float = fixed.TOLERANCE_PX, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """The samples ``key, ts, x, y`` at which a cursor has rested, with their anchor.

    Every bucket of time of a key is folded by itself, as if nothing had been before. One row a bucket then carries the
    state along the key, and only buckets that start otherwise than was assumed are folded again, until none does. So a key
    of any length is spread over tasks. Samples without a time are left out.
    """
    _, dwell, tol = limits(dwell_ms=dwell_ms, tolerance=tolerance)
    d = samples.where(F.col("ts").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.col("key").cast("string").alias("key"), F.floor(F.col("ts") / F.lit(bucket_ms)).cast("long").alias("bucket"),
        F.col("ts").cast("long").alias("ts"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def folded(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "ts", "x", "y")
        return rows.mapInArrow(_folder(dwell, tol), _BUCKET)

    buckets = written(folded(d.withColumn("start", F.lit(None).cast(_STATE))), "buckets")
    while True:
        in_order = buckets.repartition("key").sortWithinPartitions("key", "bucket")
        changed = written(in_order.mapInArrow(_carrier(dwell, tol), f"{_BUCKET}, again boolean"), "changed")
        again = changed.where("again").select(F.col("key").alias("k"), F.col("bucket").alias("b"), "start")
        kept = buckets.join(changed.select("key", "bucket"), [buckets["key"].eqNullSafe(changed["key"]), buckets["bucket"] == changed["bucket"]], "left_anti")
        buckets = kept.unionByName(changed.where("not again").drop("again"))
        if again.isEmpty():
            break
        rows = d.join(again, d["key"].eqNullSafe(again["k"]) & (d["bucket"] == again["b"])).drop("k", "b")
        buckets = written(buckets.unionByName(folded(rows)), "buckets")
    return buckets.select("key", F.inline("fired")).select("key", *_FIRING)


def dwells_stream(
    samples: DataFrame, dwell_ms: int = fixed.DWELL_MS, tolerance: float = fixed.TOLERANCE_PX
) -> DataFrame:
    """:func:`dwells` of a streaming DataFrame ``key STRING, ts LONG, x DOUBLE, y DOUBLE`` with its state per key."""
    _, dwell, tol = limits(dwell_ms=dwell_ms, tolerance=tolerance)

    def fold(key, batches, state):
        rest = Rest()
        if state.exists:
            ax, ay, since, ex, ey = state.get
            rest = Rest((ax, ay), since, None if math.isnan(ex) else (ex, ey))
        rows = pd.concat(list(batches)).sort_values(["ts", "x", "y"])
        out = [(key[0], *f) for f in plain(rows[["ts", "x", "y"]].itertuples(index=False, name=None), rest, dwell, tol)]
        ex, ey = rest.examined or (math.nan, math.nan)
        state.update((rest.anchor[0], rest.anchor[1], int(rest.since), ex, ey))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIRED.split(", ")])

    return samples.groupBy("key").applyInPandasWithState(fold, FIRED, STATE, "append", "NoTimeout")


def sampled_stream(samples: DataFrame, poll_ms: int, lateness: str) -> DataFrame:
    """:func:`sampled` of a streaming DataFrame ``key, ts TIMESTAMP, x, y``; later samples than the watermark drop."""
    slot = F.window("ts", f"{max(poll_ms, fixed.MIN_POLL_MS)} milliseconds")
    first = F.min_by(F.struct("ts", "x", "y"), F.struct("ts", "x", "y"))
    return samples.withWatermark("ts", lateness).groupBy("key", slot).agg(first.alias("p")).select("key", "p.*")


def detection_id(key: Column, ts: Column) -> Column:
    """Identifier of a detection: the same after a retry."""
    return F.concat_ws("-", key.cast("string"), ts.cast("string"))
