"""Registration of queries, table access and SQL fragments for the packaged dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.operators.packed import Packed, packaged
from versewright.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# Tables whose rows take more work than moving them: long texts, and what files and citations are made of.
SPREAD = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "customer": "c_custkey"}


def table(spark: SparkSession, sf_dir: str, name: str, *exprs: str, key: str | None = None) -> DataFrame:
    """A table over all cores if its rows take long: always those of SPREAD, another one by the ``key`` given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if key or name in SPREAD:
        df = spread(df, key or SPREAD[name])
    return df.selectExpr(*exprs) if exprs else df


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def vers_cte(*names: str) -> str:
    """CTEs ``vers`` (chapters) and ``verse`` (verses) of packaged versifications."""
    rows = ", ".join(
        f"({lit(n)}, {b}, {chapters})" for n in names or fixed.VERSIFICATIONS
        for b, chapters in enumerate(fixed.last_verses(n), 1)
    )
    return f"""raw_vers(vers_name, book_ord, lasts) AS (VALUES {rows}),
flat_vers AS (SELECT vers_name, book_ord, unnest(lasts) AS last_verse, unnest(range(1, len(lasts) + 1)) AS chapter
  FROM raw_vers),
vers AS (SELECT vers_name, book_ord, chapter, last_verse,
  row_number() OVER (PARTITION BY vers_name ORDER BY book_ord, chapter) AS chapter_idx,
  sum(last_verse) OVER (PARTITION BY vers_name ORDER BY book_ord, chapter) - last_verse AS start_ord FROM flat_vers),
verse AS (SELECT vers_name, book_ord, chapter, v AS verse, start_ord + v AS verse_ord, last_verse, chapter_idx
  FROM (SELECT *, unnest(range(1, last_verse + 1)) AS v FROM vers))"""


def books_cte() -> str:
    rows = ", ".join(f"({i}, {lit(b)}, {lit(c)})" for i, (b, c) in enumerate(fixed.BOOKS, 1))
    return f"books(book_ord, book_id, code) AS (VALUES {rows})"


def chapters(*names: str) -> Packed:
    """Packaged versifications, packed into the plan."""
    return packaged(tuple(names) or fixed.VERSIFICATIONS)


def chapter_table(spark: SparkSession, *names: str) -> DataFrame:
    return dims.versification(spark, tuple(names) or fixed.VERSIFICATIONS)


# A reference per line item: valid verses of the KJV, every verse reached as the data grows.
ORD = "(l_orderkey * 7 + l_linenumber) % 31102 + 1"


def verse_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewright.operators import versify

    d = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", f"cast({ORD} as int) as verse_ord", "'kjv' as vers_name",
              key="l_orderkey")
    return versify.from_ordinals(d, chapters("kjv"))


# A range per line item, up to a few chapters and over the ends of books.
TO_ORD = f"least({ORD} + cast(l_quantity as int) * (l_linenumber % 3), 31102)"


def verse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, l_linenumber, vers_name, from_ord, to_ord, range``."""
    from versewright.functions import refs
    from versewright.operators import versify

    d = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", f"cast({ORD} as int) as from_ord",
        f"cast({TO_ORD} as int) as to_ord", "'kjv' as vers_name", key="l_orderkey",
    )
    kjv = chapters("kjv")
    for side in ("from", "to"):
        d = versify.from_ordinals(d, kjv, f"{side}_ord")
        d = d.withColumn(f"__{side}", refs.ref("book_ord", "chapter", "verse")).drop("book_ord", "chapter", "verse")
    return d.withColumn("range", F.struct(F.col("__from").alias("from"), F.col("__to").alias("to"))).drop("__from", "__to")


RANGES_CTE = f"""ranges AS (SELECT l_orderkey, l_linenumber, a.*, b.*, a.from_ord AS fo, b.to_ord AS t_o FROM (
  SELECT l_orderkey, l_linenumber, {ORD} AS fo_, {TO_ORD} AS to_ FROM lineitem) l
  JOIN (SELECT verse_ord AS from_ord, book_ord AS fb, chapter AS fc, verse AS fv, chapter_idx AS fi FROM verse) a
    ON a.from_ord = fo_
  JOIN (SELECT verse_ord AS to_ord, book_ord AS tb, chapter AS tc, verse AS tv, chapter_idx AS ti FROM verse) b
    ON b.to_ord = to_)"""


def flat(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """A range column as six numbers."""
    parts = {
        f"{prefix}{short}{part[0]}": F.col(f"{column}.{side}.{part}")
        for side, short in (("from", "f"), ("to", "t")) for part in ("book_ord", "chapter", "verse")
    }
    return df.select(*[c for c in df.columns if c != column], *[v.alias(k) for k, v in parts.items()])
