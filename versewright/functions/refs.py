"""Reference and range columns: ``STRUCT<book_ord, chapter, verse>`` and ``STRUCT<from, to>``.

Spark compares structs field by field, which is the canonical order of references.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def ref(book: Column | str, chapter: Column | str, verse: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(
        c(book).cast("int").alias("book_ord"), c(chapter).cast("int").alias("chapter"),
        c(verse).cast("int").alias("verse"),
    )


def ref_range(a: Column, b: Column) -> Column:
    """A closed range, its bounds sorted."""
    return F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to"))


def range_or_begin(begin: Column, end: Column) -> Column:
    """A range as requested: none without a valid begin, the begin alone without a valid end."""
    return F.when(begin.isNotNull(), ref_range(begin, F.coalesce(end, begin)))


def one_book(rng: Column) -> Column:
    """A range over two books reduced to its first verse."""
    same = rng["from"]["book_ord"] == rng["to"]["book_ord"]
    return F.when(same, rng).otherwise(F.struct(rng["from"].alias("from"), rng["from"].alias("to")))




def book_id(book_ord: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b, _ in fixed.BOOKS]), book_ord)


def book_ord(identifier: Column) -> Column:
    """Number of a book by its identifier, null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(b) for b, _ in fixed.BOOKS]), identifier)
    return F.when(at > 0, at.cast("int"))


def format_ref(r: Column) -> Column:
    return F.format_string("%s %d, %d", book_id(r["book_ord"]), r["chapter"], r["verse"])


def format_range(rng: Column) -> Column:
    return F.concat(format_ref(rng["from"]), F.lit(" - "), format_ref(rng["to"]))


def number(value: Column) -> Column:
    """A chapter or verse number: none below 1, above uint32 or where the text is no number."""
    n = value.try_cast("long")
    return F.when((n >= 1) & (n <= fixed.MAX_UINT32), n)
