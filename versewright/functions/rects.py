"""Rectangle columns ``STRUCT<x, y, w, h>``: half-open on the right and at the bottom, integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int>"


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def contains(box: Column, x: Column, y: Column) -> Column:
    return (x >= box["x"]) & (x < box["x"] + box["w"]) & (y >= box["y"]) & (y < box["y"] + box["h"])


def overlaps(begin_a: Column, end_a: Column, begin_b: Column, end_b: Column) -> Column:
    """Whether two half-open ranges share a value."""
    return (begin_a < end_b) & (begin_b < end_a)


def unite(a: Column, b: Column) -> Column:
    """The rectangle around two; of one and null the one."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right = F.greatest(a["x"] + a["w"], b["x"] + b["w"])
    bottom = F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return F.when(a.isNotNull() | b.isNotNull(), rect(x, y, right - x, bottom - y))


def padded(area: Column, line: Column) -> Column:
    """An area grown by half the height of ``line`` on every side."""
    pad = F.floor(line["h"] / 2).cast("int")
    return rect(area["x"] - pad, area["y"] - pad, area["w"] + 2 * pad, area["h"] + 2 * pad)


def clip(area: Column, width: Column, height: Column) -> Column:
    """The share of an area inside an image of that size, null if there is none."""
    x, y = F.greatest(area["x"], F.lit(0)), F.greatest(area["y"], F.lit(0))
    right, bottom = F.least(area["x"] + area["w"], width), F.least(area["y"] + area["h"], height)
    return F.when((right > x) & (bottom > y), rect(x, y, right - x, bottom - y))


def shifted(box: Column, dx: Column, dy: Column) -> Column:
    return F.when(box.isNotNull(), rect(box["x"] + dx, box["y"] + dy, box["w"], box["h"]))


def rounded(value: Column) -> Column:
    """Halves away from zero."""
    return F.when(value < 0, -F.floor(-value + 0.5)).otherwise(F.floor(value + 0.5)).cast("int")


def to_enlarged(value: Column, origin: Column, scale: float) -> Column:
    """A coordinate of the image in a copy of an area enlarged by ``scale``."""
    return rounded((value - origin) * F.lit(scale))


def from_enlarged(box: Column, origin_x: Column, origin_y: Column, scale: float) -> Column:
    """A box found in an enlarged copy in the coordinates of the image."""
    back = lambda v: rounded(v / F.lit(scale))
    return rect(origin_x + back(box["x"]), origin_y + back(box["y"]), back(box["w"]), back(box["h"]))


def centre_distance(box: Column, x: Column, y: Column) -> Column:
    """Euclidean distance of a position to the centre pixel of a box."""
    cx, cy = box["x"] + F.floor(box["w"] / 2), box["y"] + F.floor(box["h"] / 2)
    return F.sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y))


def character_boxes(box: Column, count: Column) -> Column:
    """A word box divided into ``count`` boxes of equal whole width."""
    width = F.floor(box["w"] / count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: rect(box["x"] + i * width, box["y"], width, box["h"])
    )
