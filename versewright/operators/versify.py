"""References against a versification: validity, clamping, ordinals, sizes, splitting, stepping and derivation.

A versification is a chapter table ``vers_name, book_ord, chapter, last_verse, chapter_idx, start_ord``
(:func:`versewright.dims.versification` or :func:`derive`) or one of few in a :class:`~versewright.operators.packed.Packed`.
The verse ordinal ``start_ord + verse`` turns every range operator into integer arithmetic plus a look-up: in the row for
packed versifications, by an equi-join on a chapter or an ordinal for chapter tables, never by a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, fixed
from ..functions import refs
from ..session import written
from .packed import Packed
from .skew import attach

#: Few versifications are packed into the plan, so that facts stay where they are; any number comes as a chapter table.
Chapters = DataFrame | Packed

CHAPTER = ["vers_name", "book_ord", "chapter"]


def _at_chapter(df: DataFrame, chapters: Chapters, book: Column, chapter: Column, wanted: dict[str, str]) -> DataFrame:
    """Add ``last_verse``, ``start_ord`` or ``chapter_idx`` of a chapter under new names, null if there is no such chapter."""
    if isinstance(chapters, Packed):
        vers, at = F.col("vers_name"), chapters.place(F.col("vers_name"), book, chapter)
        facts = {"last_verse": chapters.last_verse(at), "start_ord": chapters.start_ord(at), "chapter_idx": chapters.chapter_idx(vers, at)}
        return df.withColumns({name: facts[of] for of, name in wanted.items()})
    keys = {"book_ord": "__at_book", "chapter": "__at_chapter"}
    side = chapters.select("vers_name", *[F.col(c).alias(k) for c, k in (keys | wanted).items()])
    d = df.withColumns({"__at_book": book, "__at_chapter": chapter})
    return attach(d, side, ["vers_name", *keys.values()], "left").drop(*keys.values())


def _at_index(df: DataFrame, chapters: Chapters, index: str, wanted: dict[str, str]) -> DataFrame:
    """Add ``book_ord, chapter, last_verse`` or ``start_ord`` of the chapter with an index; rows without one drop out."""
    if isinstance(chapters, Packed):
        vers, at = F.col("vers_name"), chapters.place_of_index(F.col("vers_name"), F.col(index))
        facts = {"book_ord": chapters.book_ord(at), "chapter": chapters.chapter(vers, at), "last_verse": chapters.last_verse(at),
                 "start_ord": chapters.start_ord(at)}
        return df.where(at.isNotNull()).withColumns({name: facts[of] for of, name in wanted.items()})
    side = chapters.select("vers_name", F.col("chapter_idx").alias(index), *[F.col(c).alias(k) for c, k in wanted.items()])
    return attach(df, side, ["vers_name", index])


def _with_total(df: DataFrame, chapters: Chapters, name: str) -> DataFrame:
    if isinstance(chapters, Packed):
        return df.withColumn(name, chapters.total(F.col("vers_name"))).where(F.col(name).isNotNull())
    total = chapters.groupBy("vers_name").agg(F.sum("last_verse").cast("int").alias(name))
    return attach(df, total, ["vers_name"])


def verse_count(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Add ``verse_count`` of ``vers_name, book_ord, chapter``: 0 for a chapter that does not exist."""
    d = _at_chapter(df, chapters, F.col("book_ord"), F.col("chapter"), {"last_verse": "verse_count"})
    return d.withColumn("verse_count", F.coalesce("verse_count", F.lit(0)))


def valid_only(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Keep the rows whose ``book_ord, chapter, verse`` exist in the versification ``vers_name``."""
    d = _at_chapter(df, chapters, F.col("book_ord"), F.col("chapter"), {"last_verse": "__last"})
    return d.where("verse between 1 and __last").drop("__last")


def with_validity(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Add the boolean ``valid``."""
    return (
        verse_count(df, chapters).withColumn("valid", F.col("verse").between(F.lit(1), F.col("verse_count")))
        .drop("verse_count")
    )


def clamp(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Replace a reference that does not exist by the nearest that does: book, then chapter, then verse.

    A chapter that the versification lacks gives way to the next lower one it has, or to the first.
    """
    within = lambda x, hi: F.least(F.greatest(x, F.lit(1)), hi)
    d = df.withColumn("__book", within(F.col("book_ord"), F.lit(66)))
    if isinstance(chapters, Packed):
        vers = F.col("vers_name")
        d = d.withColumn("__chapter", within(F.col("chapter"), chapters.chapter_count(vers, F.col("__book"))))
        last = chapters.last_verse(chapters.place(vers, F.col("__book"), F.col("__chapter")))
    else:
        d = attach(d, dims.book_chapters(chapters).withColumnRenamed("book_ord", "__book"), ["vers_name", "__book"], "left")
        known = F.map_keys("last_verses")
        lower = F.array_max(F.filter(known, lambda c: c <= F.col("chapter")))
        d = d.withColumn("__chapter", F.coalesce(lower, F.array_min(known)))
        last = F.element_at("last_verses", F.col("__chapter"))
    d = d.withColumn("__verse", within(F.col("verse"), last))
    kept = [c for c in df.columns if c not in ("book_ord", "chapter", "verse")]
    return d.select(
        *kept, F.col("__book").alias("book_ord"), F.col("__chapter").alias("chapter"), F.col("__verse").alias("verse")
    )


def from_ordinals(df: DataFrame, chapters: Chapters, name: str = "verse_ord") -> DataFrame:
    """Add ``book_ord, chapter, verse`` of a verse ordinal; rows with an ordinal out of range drop out."""
    if isinstance(chapters, Packed):
        vers = F.col("vers_name")
        place = chapters.place_of_ordinal(vers, F.col(name))
        d = df.where(F.col(name).between(1, chapters.total(vers))).withColumn("__place", place)
        at = F.col("__place")
        return d.withColumns({
            "book_ord": chapters.book_ord(at), "chapter": chapters.chapter(vers, at),
            "verse": (F.col(name) - chapters.start_ord(at)).cast("int")}).drop("__place")
    index = dims.verse_index(chapters).select(
        "vers_name", F.col("verse_ord").alias(name), "book_ord", "chapter", "verse"
    )
    return attach(df, index, ["vers_name", name])


def to_ordinals(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Add ``verse_ord`` of ``book_ord, chapter, verse``, null for a reference that does not exist."""
    d = _at_chapter(df, chapters, F.col("book_ord"), F.col("chapter"), {"last_verse": "__last", "start_ord": "__start"})
    valid = F.col("verse").between(F.lit(1), F.col("__last"))
    return d.withColumn("verse_ord", F.when(valid, F.col("__start") + F.col("verse"))).drop("__last", "__start")


def _bound(df: DataFrame, chapters: Chapters, rng: str, side: str) -> DataFrame:
    """Add ``__{side}_ord`` and ``__{side}_idx`` of one bound of the range column ``rng``, null if invalid."""
    p, of = f"__{side}_", F.col(rng)[side]
    wanted = {"last_verse": p + "last", "start_ord": p + "start", "chapter_idx": p + "idx"}
    d = _at_chapter(df, chapters, of["book_ord"], of["chapter"], wanted)
    valid = of["verse"].between(F.lit(1), F.col(p + "last"))
    return d.withColumns({
        p + "ord": F.when(valid, F.col(p + "start") + of["verse"]), p + "idx": F.when(valid, F.col(p + "idx")),
    }).drop(p + "last", p + "start")


def _bounds(df: DataFrame, chapters: Chapters, rng: str) -> DataFrame:
    return _bound(_bound(df, chapters, rng, "from"), chapters, rng, "to")


def with_bounds(df: DataFrame, chapters: Chapters, rng: str = "range") -> DataFrame:
    """Add ``from_ord, to_ord, from_idx, to_idx``, the verse ordinals and chapter indexes of a range."""
    return _bounds(df, chapters, rng).withColumnsRenamed({
        f"__{side}_{kind}": f"{side}_{kind}" for side in ("from", "to") for kind in ("ord", "idx")
    })


def range_size(df: DataFrame, chapters: Chapters, rng: str = "range") -> DataFrame:
    """Add ``size``, the verses a range covers; null if either end does not exist."""
    d = _bounds(df, chapters, rng)
    return d.select(*df.columns, (F.col("__to_ord") - F.col("__from_ord") + 1).alias("size"))


def _by_chapter(df: DataFrame, chapters: Chapters, rng: str) -> DataFrame:
    """One row per chapter a range touches with its ``__book, __chapter, __start, __first, __final``; inner chapters are whole.

    The chapter indexes between the bounds are generated per row, so nothing is compared by range.
    """
    d = _bounds(df, chapters, rng).withColumn("__idx", F.explode(F.sequence("__from_idx", "__to_idx")))
    d = _at_index(d, chapters, "__idx", {"book_ord": "__book", "chapter": "__chapter", "last_verse": "__last", "start_ord": "__start"})
    first = F.when(F.col("__idx") == F.col("__from_idx"), F.col(rng)["from"]["verse"]).otherwise(1)
    last = F.when(F.col("__idx") == F.col("__to_idx"), F.col(rng)["to"]["verse"]).otherwise(F.col("__last"))
    return d.withColumns({"__first": first, "__final": last})


def split_by_chapter(df: DataFrame, chapters: Chapters, rng: str = "range") -> DataFrame:
    """One row per chapter a range touches, with ``part`` as its share of it."""
    bound = lambda verse: refs.ref("__book", "__chapter", verse)
    part = F.struct(bound(F.col("__first")).alias("from"), bound(F.col("__final")).alias("to")).alias("part")
    return _by_chapter(df, chapters, rng).select(*df.columns, part)


def expand(df: DataFrame, chapters: Chapters, rng: str = "range") -> DataFrame:
    """One row per verse of a range with ``verse_ord, book_ord, chapter, verse``."""
    d = _by_chapter(df, chapters, rng)
    d = d.withColumn("__verse", F.explode(F.sequence("__first", "__final")))
    return d.select(
        *df.columns, (F.col("__start") + F.col("__verse")).alias("verse_ord"), F.col("__book").alias("book_ord"),
        F.col("__chapter").alias("chapter"), F.col("__verse").alias("verse"))


def neighbours(df: DataFrame, chapters: Chapters) -> DataFrame:
    """Add ``next`` and ``prev``: the verse after and before across chapters and books, null at the ends."""
    if isinstance(chapters, Packed):
        vers, at = F.col("vers_name"), chapters.place(F.col("vers_name"), F.col("book_ord"), F.col("chapter"))
        d = df.withColumns({"__idx": chapters.chapter_idx(vers, at), "__last": chapters.last_verse(at)})
        verse, out = F.col("verse"), {}
        for name, step in (("next", 1), ("prev", -1)):
            other = chapters.place_of_index(vers, F.col("__idx") + step)
            first = F.lit(1) if step > 0 else chapters.last_verse(other)
            across = F.when(other.isNotNull(), refs.ref(chapters.book_ord(other), chapters.chapter(vers, other), first))
            within = F.when((verse + step).between(1, F.col("__last")), refs.ref("book_ord", "chapter", verse + step))
            out[name] = F.when(verse.between(1, F.col("__last")), F.coalesce(within, across))
        return d.withColumns(out).drop("__idx", "__last")
    d = to_ordinals(df, chapters)
    index = dims.verse_index(chapters)
    for name, step in (("next", 1), ("prev", -1)):
        side = index.select(
            "vers_name", (F.col("verse_ord") - step).alias("verse_ord"),
            refs.ref("book_ord", "chapter", "verse").alias(name),
        )
        d = attach(d, side, ["vers_name", "verse_ord"], "left")
    return d.drop("verse_ord")


def context_window(df: DataFrame, chapters: Chapters, verses: int = 10) -> DataFrame:
    """One row per verse from ``verses`` before to ``verses`` after a reference, clipped at the ends.

    ``row`` counts the rows of a window from 0 and ``focus_row`` is the row of the reference.  Both follow from the
    ordinals, so no window function is needed, and with packed versifications no row is moved.
    """
    d = _with_total(to_ordinals(df, chapters).where("verse_ord is not null"), chapters, "__total")
    first = F.greatest(F.col("verse_ord") - verses, F.lit(1))
    last = F.least(F.col("verse_ord") + verses, F.col("__total"))
    d = d.withColumns({"__first": first, "__last": last, "focus_row": F.col("verse_ord") - first})
    kept = [*df.columns, "focus_row", "row"]
    if isinstance(chapters, Packed):
        # The chapters of both ends are searched once a window, and those between are counted; a verse costs no search.
        vers = F.col("vers_name")
        place = lambda name: chapters.place_of_ordinal(vers, F.col(name))
        d = d.withColumn("__place", F.explode(F.sequence(place("__first"), place("__last"))))
        at = F.col("__place")
        d = d.withColumns({"__start": chapters.start_ord(at), "__end": chapters.start_ord(at) + chapters.last_verse(at),
                           "__book": chapters.book_ord(at), "__chapter": chapters.chapter(vers, at)})
        within = F.sequence(F.greatest(F.col("__first"), F.col("__start") + 1), F.least(F.col("__last"), F.col("__end")))
        d = d.withColumn("__ord", F.explode(within)).withColumn("row", F.col("__ord") - F.col("__first"))
        return d.select(*kept, refs.ref("__book", "__chapter", F.col("__ord") - F.col("__start")).alias("context"))
    d = d.withColumn("__ord", F.explode(F.sequence(F.col("__first"), F.col("__last"))))
    d = d.withColumn("row", F.col("__ord") - F.col("__first"))
    d = d.select(F.struct(*kept).alias("__row"), "vers_name", "__ord")
    d = from_ordinals(d, chapters, "__ord").withColumn("context", refs.ref("book_ord", "chapter", "verse"))
    return d.select("__row.*", "context")


def page(df: DataFrame, chapters: Chapters, count: int, forward: bool = True) -> DataFrame:
    """The next (or previous) ``count`` verses of each loaded window ``first_ord .. last_ord``, in reading order."""
    d = _with_total(df, chapters, "__total")
    if forward:
        lo, hi = F.col("last_ord") + 1, F.least(F.col("last_ord") + count, F.col("__total"))
    else:
        lo, hi = F.greatest(F.col("first_ord") - count, F.lit(1)), F.col("first_ord") - 1
    d = d.where(lo <= hi).withColumn("verse_ord", F.explode(F.sequence(lo, hi))).drop("__total")
    return from_ordinals(d, chapters)


def chapter_counts(chapters: DataFrame) -> DataFrame:
    """``chapter_count`` per versification and book: its last chapter number."""
    return chapters.groupBy("vers_name", "book_ord").agg(F.max("chapter").alias("chapter_count"))


def book_starts(chapters: DataFrame) -> DataFrame:
    """Row of the first chapter and verses before it for each book."""
    return chapters.groupBy("vers_name", "book_ord").agg(
        (F.min("chapter_idx") - 1).alias("start_idx"), F.min("start_ord").alias("start_ord")
    )


def total_verses(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("vers_name").agg(F.sum("last_verse").alias("verses"))


def parsed(df: DataFrame, chapters: Chapters, book: str, chapter: str, verse: str) -> tuple[DataFrame, DataFrame]:
    """References given as texts: those that exist, with ``book_ord, chapter, verse``, and the others with an ``error``.

    Errors, the first that applies: ``unknown book``, ``no number`` (none, below 1 or above the largest), ``no such verse``.
    """
    names = {"__book": refs.book_ord(F.col(book)), "__chapter": refs.number(F.col(chapter)), "__verse": refs.number(F.col(verse))}
    d = _at_chapter(df.withColumns(names), chapters, F.col("__book"), F.col("__chapter"), {"last_verse": "__last"})
    error = F.when(F.col("__book").isNull(), "unknown book").when(
        F.col("__chapter").isNull() | F.col("__verse").isNull(), "no number").when(
        ~F.coalesce(F.col("__verse") <= F.col("__last"), F.lit(False)), "no such verse")
    d = d.withColumn("__error", error)
    kept = [c for c in df.columns if c not in ("book_ord", "chapter", "verse")]
    good = d.where("__error is null").select(*kept, *[F.col(f"__{c}").cast("int").alias(n) for c, n in (
        ("book", "book_ord"), ("chapter", "chapter"), ("verse", "verse"))])
    return good, d.where("__error is not null").select(*df.columns, F.col("__error").alias("error"))


# --- versifications derived from observed verses -----------------------------------------------------------------------


def chapter_ends(verses: DataFrame) -> DataFrame:
    """``scripture, book_ord, chapter, last_verse`` of observed verses; partial maxima are taken before the shuffle."""
    return verses.groupBy("scripture", "book_ord", "chapter").agg(F.max("verse").cast("int").alias("last_verse"))


def closest_default(ends: DataFrame, defaults: DataFrame, listed: tuple[str, ...] = fixed.VERSIFICATIONS) -> DataFrame:
    """``scripture, closest``: the default with most equal chapter ends, the first ``listed`` one on a tie.

    Defaults that aren't listed come after those that are, by name.
    """
    keys = ["book_ord", "chapter", "last_verse"]
    hits = attach(ends, defaults.select("vers_name", *keys), keys).groupBy("scripture", "vers_name").count()
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, listed)), F.col("vers_name")), F.lit(0)), F.lit(len(listed) + 1))
    best = hits.groupBy("scripture").agg(
        F.min_by("vers_name", F.struct(-F.col("count"), rank, F.col("vers_name"))).alias("closest")
    )
    all_scriptures = ends.select("scripture").distinct()
    first = defaults.agg(F.min_by("vers_name", F.struct(rank, F.col("vers_name"))).alias("first"))
    return (
        all_scriptures.join(best, "scripture", "left").join(F.broadcast(first))
        .select("scripture", F.coalesce("closest", "first").alias("closest"))
    )


def lacking_books(ends: DataFrame, books: DataFrame) -> DataFrame:
    """``scripture, book_ord`` of the books a scripture has no verse of.

    One row per scripture holds the set of its books (66 at most); the rest of the canon is exploded from it.
    """
    canon = F.array_sort(F.collect_set("book_ord"))
    all_books = books.agg(canon.alias("canon"))
    present = ends.groupBy("scripture").agg(F.collect_set("book_ord").alias("present"))
    return present.join(F.broadcast(all_books)).select(
        "scripture", F.explode(F.array_except("canon", "present")).alias("book_ord")
    )


def fill_lacking(ends: DataFrame, books: DataFrame, defaults: DataFrame) -> DataFrame:
    """Chapter ends of a scripture and, for every book it lacks, those of the closest default."""
    lacking = attach(lacking_books(ends, books), closest_default(ends, defaults), ["scripture"])
    filler = attach(
        lacking.withColumnRenamed("closest", "vers_name"),
        defaults.select(*CHAPTER, "last_verse"),
        ["vers_name", "book_ord"],
    )
    cols = ["scripture", "book_ord", "chapter", "last_verse"]
    return ends.select(*cols).unionByName(filler.select(*cols))


def derive(verses: DataFrame, books: DataFrame, defaults: DataFrame) -> DataFrame:
    """The complete versification of every scripture as a chapter table named after it.

    The chapter ends, which are asked several times, are written, so that the verses are read once.
    """
    filled = fill_lacking(written(chapter_ends(verses), "ends"), books, defaults)
    return dims.with_ordinals(filled.withColumnRenamed("scripture", "vers_name"))


def complete(chapters: DataFrame) -> DataFrame:
    """``vers_name, complete``: whether a versification has chapters of all 66 books."""
    return chapters.groupBy("vers_name").agg((F.count_distinct("book_ord") == 66).alias("complete"))


def intern(chapters: DataFrame, defaults: DataFrame) -> DataFrame:
    """``vers_name, same_as``: the default a versification equals chapter by chapter, else itself.

    Equality is exact: as many chapters as the default and every one of them the same.
    """
    keys = ["book_ord", "chapter", "last_verse"]
    sizes = chapters.groupBy("vers_name").agg(F.count(F.lit(1)).alias("n"))
    default_sizes = defaults.groupBy(F.col("vers_name").alias("default_name")).agg(F.count(F.lit(1)).alias("n"))
    equal = (
        attach(chapters, defaults.select(F.col("vers_name").alias("default_name"), *keys), keys)
        .groupBy("vers_name", "default_name").agg(F.count(F.lit(1)).alias("n"))
    )
    same = (
        equal.join(sizes, ["vers_name", "n"]).join(F.broadcast(default_sizes), ["default_name", "n"])
        .groupBy("vers_name").agg(F.min("default_name").alias("default_name"))
    )
    return sizes.join(same, "vers_name", "left").select(
        "vers_name", F.coalesce("default_name", "vers_name").alias("same_as")
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chapters of two versifications that differ, both ways; empty exactly if they are equal apart from names."""
    cols = ["book_ord", "chapter", "last_verse"]
    left, right = a.select(*cols), b.select(*cols)
    return (
        left.exceptAll(right).withColumn("side", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


def choose(df: DataFrame, own: DataFrame, fallback: str = "kjv") -> DataFrame:
    """Add ``vers_name`` for ``scripture``: the versification of its own file, else the fallback."""
    named = own.select(F.col("vers_name").alias("scripture")).distinct().withColumn("__own", F.lit(True))
    d = attach(df, named, ["scripture"], "left")
    return d.withColumn("vers_name", F.when(F.col("__own"), F.col("scripture")).otherwise(F.lit(fallback))).drop("__own")

