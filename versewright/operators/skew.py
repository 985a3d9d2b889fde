"""Joins and ordered operators that stay balanced when one key holds a large share of the rows.

* :func:`attach` broadcasts a side only where the caller knows it to be bounded by what it is. All else is left to
  adaptive execution, which broadcasts by the measured size of a shuffle and splits partitions that a hot key makes large.
* :func:`islands` numbers the runs of consecutive rows of a key.  It splits every key into buckets of its order
  column: the per-bucket work is an ordinary window, and only one summary row per bucket travels along the key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", bounded: bool = False) -> DataFrame:
    """Equi-join ``right`` to ``left`` (inner, left, left_semi or left_anti).

    ``bounded`` says that ``right`` can't grow with the data, such as a row per book; only then is it broadcast.
    """
    return left.join(F.broadcast(right) if bounded else right, keys, how)


#: Bits of a map of wanted keys: 16 MB, however many keys there are. With more than a bit a key it is worth less, never wrong.
BITS = 1 << 27


def likely(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose keys may stand in ``wanted``: all that do and a few others, for a join that follows.

    A map of bits by the hash of the keys is broadcast, whose size is fixed, so that the other rows aren't shuffled.
    """
    number = lambda d: (F.pmod(F.xxhash64(*[F.col(k).cast(df.schema[k].dataType) for k in keys]), F.lit(BITS)) + 1).alias("__n")
    bits = wanted.select(number(wanted)).groupBy(F.bitmap_bucket_number("__n").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__n")).alias("__bits"))
    d = df.select("*", number(df)).withColumns({"__bucket": F.bitmap_bucket_number("__n"), "__at": F.bitmap_bit_position("__n")})
    d = attach(d, bits, ["__bucket"], bounded=True)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return d.where(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1).select(*df.columns)


def fetched(wanted: DataFrame, df: DataFrame, keys: list[str], *columns: Column | str) -> DataFrame:
    """Inner join of ``wanted``, a stored table, with ``columns`` (all by default) of the few rows of ``df`` that have its keys."""
    rows = likely(df, keys, wanted)
    return attach(wanted, rows.select(*keys, *columns) if columns else rows, keys)


def islands(
    df: DataFrame, keys: list[str], order: str, width: int,
    specs: dict[str, tuple[Column, Callable[[Column, Column], Column]]], tiebreak: tuple[str, ...] = (),
    skipping: tuple[str, ...] = (), around: tuple[str, ...] = (),
) -> DataFrame:
    """Number runs of consecutive rows per ``keys`` in the order of a numeric column, counted from 1.

    ``specs`` maps an output column to a value and a test ``begins(previous, current)`` that tells where a run begins.
    A window group spans at most ``width`` of the order column; ``tiebreak`` orders rows equal in it. Columns named in
    ``skipping`` pass over rows without a value, which get no number; for those in ``around`` there is a column ``…_around``
    too, which numbers a row without a value as the run it stands inside. All of them come from one shuffle of the rows.
    """
    at = F.struct(order, *tiebreak)
    d = df.withColumn("__b", F.floor(F.col(order) / F.lit(width)).cast("long"))
    # The join below drops these; said here, both of its sides are one shuffle.
    d = d.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, "__b")]))
    held = lambda n, v: F.when(v.isNotNull(), F.struct(v.alias("v"))) if n in skipping else F.struct(v.alias("v"))
    d = d.withColumns({f"__v_{n}": held(n, v) for n, (v, _) in specs.items()})
    inner = Window.partitionBy(*keys, "__b").orderBy(order, *tiebreak)
    flag = lambda begins, prev, cur: F.coalesce(begins(prev["v"], cur["v"]), F.lit(False)).cast("int")
    # The last value before a row, of this bucket or of the buckets before.
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumns({f"__p_{n}": last(f"__v_{n}", inner) for n in specs})
    d = d.withColumns({
        f"__f_{n}": F.when(F.col(f"__p_{n}").isNull() | F.col(f"__v_{n}").isNull(), 0).otherwise(
            flag(b, F.col(f"__p_{n}"), F.col(f"__v_{n}"))
        ) for n, (_, b) in specs.items()
    })
    valued = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), at)
    summary = d.groupBy(*keys, "__b").agg(*[x for n in specs for x in (
        F.min_by(f"__v_{n}", valued(n)).alias(f"__first_{n}"), F.max_by(f"__v_{n}", valued(n)).alias(f"__last_{n}"),
        F.sum(f"__f_{n}").alias(f"__sum_{n}"),
    )])
    along = Window.partitionBy(*keys).orderBy("__b")
    summary = summary.withColumns({f"__carry_{n}": last(f"__last_{n}", along) for n in specs})
    summary = summary.withColumns({
        f"__open_{n}": F.when(F.col(f"__first_{n}").isNull(), 0).when(F.col(f"__carry_{n}").isNull(), 1).otherwise(
            flag(b, F.col(f"__carry_{n}"), F.col(f"__first_{n}"))
        ) for n, (_, b) in specs.items()
    })
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "__b", *[
        (F.coalesce(F.sum(F.col(f"__open_{n}") + F.col(f"__sum_{n}")).over(before), F.lit(0)) + F.col(f"__open_{n}"))
        .alias(f"__base_{n}") for n in specs
    ])
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__run_{n}": F.sum(f"__f_{n}").over(run) for n in specs})
    # At most ``width`` of the order per key and bucket, and partitioned for the window already: a plain join.
    d = d.join(carried, [*keys, "__b"])
    return d.select(*df.columns, *[
        F.when(F.col(f"__v_{n}").isNotNull(), F.col(f"__base_{n}") + F.col(f"__run_{n}")).alias(n) for n in specs
    ], *[(F.col(f"__base_{n}") + F.col(f"__run_{n}")).alias(f"{n}_around") for n in around])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
