"""Packaged dimensions.  All are of fixed size: 66 books, 1189 chapters and 31 103 verses per packaged versification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixed
from .operators import packed


def _table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(list(types.items()))))


def books(spark: SparkSession) -> DataFrame:
    """``book_ord, book_id, usfm_code`` in canon order."""
    ids, codes = zip(*fixed.BOOKS)
    return _table(
        spark,
        {"book_ord": list(range(1, 67)), "book_id": list(ids), "usfm_code": list(codes)},
        {"book_ord": pa.int32(), "book_id": pa.string(), "usfm_code": pa.string()},
    )


def versification(spark: SparkSession, names: tuple[str, ...] = fixed.VERSIFICATIONS) -> DataFrame:
    """``vers_name, book_ord, chapter, last_verse, chapter_idx, start_ord`` of the packaged versifications.

    ``start_ord`` counts the verses before the chapter, so ``start_ord + verse`` is the ordinal of a verse.
    """
    return packed.packaged(names).table(spark)


def with_ordinals(chapters: DataFrame) -> DataFrame:
    """Add ``chapter_idx`` and ``start_ord`` to any ``vers_name, book_ord, chapter, last_verse`` table.

    The window is per versification, at most some 1200 chapters each.
    """
    w = Window.partitionBy("vers_name").orderBy("book_ord", "chapter")
    return chapters.select(
        "vers_name",
        "book_ord",
        "chapter",
        "last_verse",
        F.row_number().over(w).cast("int").alias("chapter_idx"),
        (F.sum("last_verse").over(w) - F.col("last_verse")).cast("int").alias("start_ord"),
    )


def book_chapters(chapters: DataFrame) -> DataFrame:
    """One row per ``vers_name, book_ord`` with the maps ``last_verses`` and ``starts`` by chapter, and its last chapter.

    A chapter that a versification lacks is missing in the maps too.
    """
    by_chapter = lambda value: F.map_from_entries(F.collect_list(F.struct("chapter", value)))
    return chapters.groupBy("vers_name", "book_ord").agg(
        by_chapter("last_verse").alias("last_verses"), by_chapter("start_ord").alias("starts"),
        F.max("chapter").alias("chapter_count"),
    )


def verse_index(chapters: DataFrame) -> DataFrame:
    """``vers_name, verse_ord, book_ord, chapter, verse, last_verse``: every verse with its ordinal."""
    return chapters.select(
        "vers_name", "book_ord", "chapter", "last_verse", "start_ord",
        F.explode(F.sequence(F.lit(1), F.col("last_verse"))).alias("verse"),
    ).select(
        "vers_name", (F.col("start_ord") + F.col("verse")).alias("verse_ord"), "book_ord", "chapter", "verse",
        "last_verse",
    )


def book_names(spark: SparkSession, lang: str | None = None) -> DataFrame:
    """``lang, book_ord, variant, priority``; of two variants matching at one place the higher priority wins."""
    rows = [(l, b, n, i) for l in ("en", "de") if lang in (None, l) for i, (b, n) in enumerate(fixed.names_of(l), 1)]
    langs, ords, names, priorities = map(list, zip(*rows))
    return _table(
        spark,
        {"lang": langs, "book_ord": ords, "variant": names, "priority": priorities},
        {"lang": pa.string(), "book_ord": pa.int32(), "variant": pa.string(), "priority": pa.int32()},
    )


def name_aliases(names: DataFrame) -> DataFrame:
    """Every spelling OCR may have misread a variant as: ``lang, book_ord, variant, alias``, the variant left out.

    The spellings of a name grow letter by letter as an array, so the expansion is one narrow projection.
    """
    meant = {}
    for read, right in fixed.MISREAD:
        meant.setdefault(right, []).append(read)
    variants_of = F.create_map(*[x for c, r in meant.items() for x in (F.lit(c), F.array(*map(F.lit, [c, *r])))])

    def grow(spellings, letter):
        choices = F.coalesce(variants_of[letter], F.array(letter))
        return F.flatten(F.transform(spellings, lambda s: F.transform(choices, lambda c: F.concat(s, c))))

    spellings = F.aggregate(F.split("variant", ""), F.array(F.lit("")), grow)
    return names.select("lang", "book_ord", "variant", F.explode(spellings).alias("alias")).where("alias != variant")
