"""End-to-end pipelines over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import cite, extract, packed, versify


def citation_counts(texts: DataFrame, lang: str = "de", vers_name: str = "esv") -> DataFrame:
    """``book_ord, ranges, verses``: how often and how widely texts cite each book.

    One pass over the texts; the only shuffle is the one of 66 partial counts per task.
    """
    chapters = packed.packaged()
    found = extract.find_citations(texts, chapters, "text", lang, vers_name)
    spans = found.select("vers_name", "book_ord", F.explode("ranges").alias("range"))
    sized = versify.range_size(spans, chapters)
    return sized.groupBy("book_ord").agg(
        F.count(F.lit(1)).alias("ranges"), F.sum("size").cast("long").alias("verses")
    )


def cited_text(
    texts: DataFrame, lang: str, mask: str, scripture: str, scriptures: DataFrame, scripture_books: DataFrame,
    verses: DataFrame, own_versifications: DataFrame, fallback: str = "kjv",
) -> DataFrame:
    """Every range cited in the texts with its citation from a scripture.

    The versification is the scripture's own one if it has one, else the fallback.
    """
    spark = texts.sparkSession
    wanted = spark.range(1).select(F.lit(scripture).alias("scripture"))
    defaults = dims.versification(spark)
    chapters = defaults.unionByName(own_versifications)
    vers_name = versify.choose(wanted, own_versifications, fallback).first()["vers_name"]
    found = extract.find_citations(texts, chapters, "text", lang, vers_name)
    ranges = found.withColumn("scripture", F.lit(scripture)).withColumn("range", F.explode("ranges")).drop("ranges")
    return cite.citations(ranges, mask, scriptures, scripture_books, verses, chapters)
