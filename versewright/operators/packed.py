"""Versifications as arrays in the plan, so that facts meet them in their own row and are never moved.

All versifications of a :class:`Packed` stand behind each other, chapter by chapter. A chapter's place follows from where its
book begins; last verses and verses before a chapter are read at its place; an ordinal finds its chapter in a window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

#: More versifications than this belong in a chapter table, which is joined.
MOST = 16
BOOKS = 66
#: Ordinals of a window, as a power of two.
WINDOW_BITS = 5


def _array(numbers: Sequence[int]) -> Column:
    """A constant array; written as text, which is folded to one value while the query is planned."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


class Packed:
    """Versifications by name, each a list of the last verses of the chapters of each of the 66 books."""

    def __init__(self, tables: dict[str, list[list[int]]]):
        if len(tables) > MOST:
            raise ValueError(f"at most {MOST} versifications are packed")
        if any(len(books) != BOOKS for books in tables.values()):
            raise ValueError("a versification has 66 books")
        self.tables = tables
        lasts = [list(chain.from_iterable(books)) for books in tables.values()]
        self.sizes = [len(x) for x in lasts]
        self.bases = [0, *accumulate(self.sizes)][:-1]
        self._last = _array([n for x in lasts for n in x])
        self._start = _array([n for x in lasts for n in list(accumulate(x, initial=0))[:-1]])
        self._book = _array([b for books in tables.values() for b, chapters in enumerate(books, 1) for _ in chapters])
        # Starts counted through all versifications, and for windows of ordinals the chapter that each begins in.
        self._offsets = [0, *accumulate(map(sum, lasts))][:-1]
        through = list(accumulate(chain.from_iterable(lasts), initial=0))
        windows = range(0, through[-1], 1 << WINDOW_BITS)
        begun = [bisect_right(through, w, hi=len(through) - 1) - 1 for w in windows]
        ends = [bisect_left(through, w + (1 << WINDOW_BITS), hi=len(through) - 1) - 1 for w in windows]
        self._through, self._begun = _array(through[:-1]), _array(begun)
        self._most_begin = max((e - b for b, e in zip(begun, ends)), default=0)
        # Where each book's chapters begin; one more entry ends the last book.
        self._firsts = [[base, *accumulate(map(len, books), initial=base)][1:] for base, books in zip(self.bases, tables.values())]

    @classmethod
    def of(cls, chapters: DataFrame) -> Packed:
        """Of a chapter table with few versifications whose chapters have no gaps; an error for any other."""
        rows = chapters.select("vers_name", "book_ord", "chapter", "last_verse").limit(MOST * 2000 + 1).collect()
        if len(rows) > MOST * 2000:
            raise ValueError(f"at most {MOST} versifications are packed")
        tables: dict[str, list[list[int]]] = {}
        for r in sorted(rows):
            books = tables.setdefault(r.vers_name, [[] for _ in range(BOOKS)])
            if not 1 <= r.book_ord <= BOOKS or r.chapter != len(books[r.book_ord - 1]) + 1:
                raise ValueError(f"chapters of {r.vers_name} have a gap or are repeated")
            books[r.book_ord - 1].append(r.last_verse)
        return cls(tables)

    def table(self, spark: SparkSession) -> DataFrame:
        """The same as a chapter table."""
        columns: dict[str, list] = {k: [] for k in ("vers_name", "book_ord", "chapter", "last_verse", "chapter_idx", "start_ord")}
        for name, books in self.tables.items():
            idx = total = 0
            for book_ord, lasts in enumerate(books, 1):
                for chapter, last in enumerate(lasts, 1):
                    idx += 1
                    for key, value in zip(columns, (name, book_ord, chapter, last, idx, total)):
                        columns[key].append(value)
                    total += last
        types = {k: pa.int32() for k in columns} | {"vers_name": pa.string()}
        return spark.createDataFrame(pa.table(columns, schema=pa.schema(list(types.items()))))

    def _of(self, vers: Column, values: Sequence[Column]) -> Column:
        """What belongs to the versification of the row; null for an unknown one."""
        chosen = None
        for name, value in zip(self.tables, values):
            chosen = F.when(vers == name, value) if chosen is None else chosen.when(vers == name, value)
        return chosen if chosen is not None else F.lit(None).cast("int")

    def total(self, vers: Column) -> Column:
        """Verses of the versification."""
        return self._of(vers, [F.lit(sum(chain.from_iterable(books))) for books in self.tables.values()])

    def _base(self, vers: Column) -> Column:
        return self._of(vers, [F.lit(b) for b in self.bases])

    def _first(self, vers: Column, book: Column, after: int = 0) -> Column:
        return self._of(vers, [F.get(_array(x), book - 1 + after) for x in self._firsts])

    def chapter_count(self, vers: Column, book: Column) -> Column:
        return self._first(vers, book, 1) - self._first(vers, book)

    def place(self, vers: Column, book: Column, chapter: Column) -> Column:
        """Place of a chapter in the arrays; null if there is no such chapter."""
        return F.when(chapter.between(1, self.chapter_count(vers, book)), self._first(vers, book) + chapter - 1).cast("int")

    def place_of_index(self, vers: Column, index: Column) -> Column:
        size = self._of(vers, [F.lit(n) for n in self.sizes])
        return F.when(index.between(1, size), self._base(vers) + index - 1).cast("int")

    def place_of_ordinal(self, vers: Column, ordinal: Column) -> Column:
        """Place of the chapter that a verse ordinal is in: the last one that begins before it.

        The ordinals of all versifications are counted through; a window of them knows the chapter that it begins in, and only
        the few chapters that begin inside it are looked at.
        """
        at = self._of(vers, [F.lit(x) for x in self._offsets]) + ordinal
        begun = F.get(self._begun, F.shiftright(at - 1, WINDOW_BITS).try_cast("int"))
        later = [F.when(F.get(self._through, begun + k) < at, 1).otherwise(0) for k in range(1, self._most_begin + 1)]
        return F.when(ordinal.between(1, self.total(vers)), sum(later, begun)).cast("int")

    def last_verse(self, place: Column) -> Column:
        return F.get(self._last, place)

    def start_ord(self, place: Column) -> Column:
        return F.get(self._start, place)

    def book_ord(self, place: Column) -> Column:
        return F.get(self._book, place)

    def chapter(self, vers: Column, place: Column) -> Column:
        return (place - self._first(vers, self.book_ord(place)) + 1).cast("int")

    def chapter_idx(self, vers: Column, place: Column) -> Column:
        return (place - self._base(vers) + 1).cast("int")


def packaged(names: tuple[str, ...] = fixed.VERSIFICATIONS) -> Packed:
    """The packaged versifications."""
    return Packed({name: [list(book) for book in fixed.last_verses(name)] for name in names})
