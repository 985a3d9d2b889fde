"""Providers users add: lookup sites, scriptures and archive readers.

A provider exchanges Columns or DataFrames, so what it adds runs as part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cite
from .operators.skew import attach, union_all
from .sources import archives

SCHEMAS = {
    "scriptures": "scripture string, abbreviation string, language string, copyright string",
    "scripture_books": "scripture string, book_ord int, abbreviation string, short_name string, long_name string",
    "verses": "scripture string, book_ord int, chapter int, verse int, markup string, cross_references array<string>",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check the columns of a provider's table: none missing, none unknown, each of its type."""
    wanted = dict(c.strip().split(" ", 1) for c in SCHEMAS[table].split(", "))
    given = dict(df.dtypes)
    if given != wanted:
        wrong = {c: (given.get(c), wanted.get(c)) for c in {*given, *wanted} if given.get(c) != wanted.get(c)}
        raise ValueError(f"table {table} of a provider does not conform: {wrong}")
    return df.select(*wanted)


@dataclass
class LookupProvider:
    """A lookup site: ``translations(language)`` gives an array Column, ``url(...)`` the URL Column of one chapter."""

    translations: Callable[[Column], Column]
    url: Callable[[Column, Column, Column, Column, Column], Column]


@dataclass
class Registry:
    lookups: dict[str, LookupProvider] = field(default_factory=dict)
    scriptures: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    readers: list[tuple[int, str, Callable[[DataFrame], dict[str, DataFrame]]]] = field(default_factory=list)

    def add_lookup(self, name: str, provider: LookupProvider) -> None:
        self.lookups[name] = provider

    def add_scriptures(self, provider: str, tables: dict[str, DataFrame]) -> None:
        """Scriptures of a provider are known as ``name (provider)``."""
        named = F.concat("scripture", F.lit(f" ({provider})"))
        self.scriptures[provider] = {
            t: conform(df, t).withColumn("scripture", named) for t, df in tables.items()
        }

    def add_reader(self, name: str, reader: Callable[[DataFrame], dict[str, DataFrame]], rank: int = 100) -> None:
        self.readers.append((rank, name, reader))
        self.readers.sort(key=lambda r: r[:2])

    def table(self, name: str) -> DataFrame | None:
        frames = [tables[name] for tables in self.scriptures.values() if name in tables]
        return union_all(frames) if frames else None

    def read(self, entries: DataFrame) -> dict[str, DataFrame]:
        """Archives read by the first reader, by rank, that answers with verses or an error."""
        outputs, left = [], entries
        for _, _, reader in self.readers:
            out = reader(left)
            outputs.append(out)
            left = attach(left, out["status"].select("file"), ["file"], "left_anti")
        return {t: union_all([o[t] for o in outputs]) for t in outputs[0]}


def default_registry() -> Registry:
    registry = Registry()
    for site in ("bible_com", "bibleserver"):
        registry.add_lookup(site, LookupProvider(
            lambda language, s=site: cite.choose_translations(F.lit(None).cast("array<string>"), language, s),
            lambda *args, s=site: cite.lookup_url(s, *args),
        ))
    registry.add_reader("usfm and usx", archives.read_archives, 0)
    return registry


def register_functions(spark: SparkSession, functions: dict[str, Callable]) -> None:
    """User functions for SQL: scalar and pandas UDFs by ``udf.register``, table functions by ``udtf.register``."""
    for name, function in functions.items():
        table = type(function).__name__ == "UserDefinedTableFunction"
        (spark.udtf if table else spark.udf).register(name, function)
