"""Extraction of references from noisy text.

Everything is a Column over the text of one row: one pattern finds names with their passages, the lengths of matches
and gaps give the offsets, and a fold over the few sections of a passage yields its ranges.  Documents never leave
their row, so extraction needs no shuffle; the only join adds the chapters of a book (66 rows per versification).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, fixed
from ..functions import refs
from ..functions import text as tx
from .packed import Packed
from .skew import attach
from .versify import Chapters

RANGES = (
    "array<struct<from:struct<book_ord:int,chapter:int,verse:int>,to:struct<book_ord:int,chapter:int,verse:int>>>"
)
PART = "array<struct<fc:bigint,fv:bigint,tc:bigint,tv:bigint>>"


def prefilter(text: Column) -> Column:
    """Cheap test a text with a reference always passes: a digit somewhere."""
    return text.rlike("[0-9]")


# Noncharacters that mark the matches inside a text; a text holding them gets replacement characters of equal length.
OPEN, CLOSE = "\uFDD0", "\uFDD1"


#: Numbers summed in one go; a long list is summed block by block, so that no step copies the whole list.
BLOCK = 256


def running(values: Column) -> Column:
    """The sums of an array up to and including each number."""
    def summed(block):
        start = F.array().cast("array<int>")
        return F.aggregate(block, start, lambda out, v: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + v)))

    def joined(blocks):
        totals = summed(F.transform(blocks, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0))))
        return tx.let(totals, lambda t: F.flatten(F.transform(blocks, lambda x, i: F.transform(
            x, lambda v: v + F.coalesce(F.get(t, i - 1), F.lit(0))))))

    def cut(v):
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda at: summed(F.slice(v, at, BLOCK)))

    return tx.let(values, lambda v: tx.let(cut(v), joined))


def matches(text: Column, lang: str) -> Column:
    """``ARRAY<STRUCT<begin, end, book_ord, passage>>``: every book name with digits behind it, with its offsets.

    One pass of the pattern marks the matches; the lengths of the pieces between the marks add up to the offsets.
    """
    unmarked = ~text.contains(OPEN) & ~text.contains(CLOSE)
    clean = F.when(unmarked, text).otherwise(F.translate(text, OPEN + CLOSE, "\uFFFD\uFFFD"))
    marked = F.regexp_replace(clean, tx.citation_pattern(lang), f"{OPEN}$0{CLOSE}")
    # The first piece is what is before all matches; each other one a match, its closing mark and the text behind it.
    sizes = lambda pieces: F.transform(pieces, lambda p, i: F.char_length(p) - F.when(i > 0, 1).otherwise(0))

    def placed(pieces, ends):
        return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)) - 1), lambda p, i: F.struct(
            F.get(ends, i).alias("begin"), F.substring_index(p, CLOSE, 1).alias("text")))

    found = tx.let(F.split(marked, OPEN, -1), lambda pieces: tx.let(running(sizes(pieces)), lambda ends: placed(pieces, ends)))
    return F.when(prefilter(text), F.transform(found, lambda m: _named(m, lang)))


def _named(match: Column, lang: str) -> Column:
    """A match with its book and the text behind the name."""
    spelled = F.regexp_extract(match["text"], f"^{tx.spelled_name(lang)}{_behind_name(lang)}", 0)
    size = F.char_length(match["text"])
    return tx.let(spelled, lambda name: F.struct(
        match["begin"].alias("begin"),
        (match["begin"] + size).alias("end"),
        book_of_name(name, lang).alias("book_ord"),
        F.substring(match["text"], F.char_length(name) + 1, size).alias("passage"),
    ))


def _behind_name(lang: str) -> str:
    """What follows the name inside a match: its passage or nothing."""
    letters = fixed.LETTERS[lang]
    return f"(?=(?:[^{letters}]|[{fixed.POSTFIX_LETTERS}])*+$)"


def _folded(name: str) -> str:
    for read, right in (("0", "o"), ("O", "o"), ("I", "1"), ("l", "1"), ("m", "M"), ("S", "s")):
        name = name.replace(read, right)
    return name


def book_of_name(name: Column, lang: str) -> Column:
    """Book of a spelled name: dropped characters removed, misread characters folded, then one map lookup."""
    known = {_folded(n): b for b, n in fixed.names_of(lang)}
    table = F.expr("str_to_map('" + ",".join(f"{n}:{b}" for n, b in known.items()) + "')")
    dropped = "".join(map(chr, [*fixed.WHITESPACE_CODES, *fixed.LINE_CODES, ord(".")]))
    spelled = F.translate(name, "0OIlmS" + dropped, "oo11Ms")
    return F.element_at(table, spelled).cast("int")


def template(passage: Column) -> Column:
    """Numbers and the separators between them: ``3,16.18-20``.  Of several separators in a row the first counts."""
    numbers_end = F.regexp_replace(passage, "ff?\\.", "")
    lines = F.regexp_replace(numbers_end, f"[{tx.LINE}]", "-")
    kept = F.regexp_replace(lines, "[^0-9,;.:&+-]", "")
    inner = F.regexp_replace(kept, "^[^0-9]+|[^0-9]+$", "")
    return F.regexp_replace(inner, "([,;.:&+-])[,;.:&+-]+", "$1")


def separators(tmpl: Column) -> Column:
    """The separators that may part chapter and verse, ``-`` excluded, in the order first seen."""
    return F.array_distinct(F.regexp_extract_all(tmpl, F.lit("[,;.:&+]"), F.lit(0)))


def sections(tmpl: Column, candidate: Column) -> Column:
    """A template split at every separator but the candidate, which becomes ``X``, and ``-``."""
    marked = F.replace(tmpl, candidate, F.lit("X"))
    return F.split(marked, "[,;.:&+]")


def section_ranges(parts: Column, last_verses: Column) -> Column:
    """Fold over the sections of a template: ``STRUCT<ok, out>`` with one range per section.

    ``last_verses`` maps the chapters of the book to their last verses.  A section opens at chapter level until a
    separator names a verse; the level and the chapter carry over to the sections behind it.
    """
    def last_of(chapter):
        return F.coalesce(F.try_element_at(last_verses, chapter.try_cast("int")), F.lit(0)).cast("long")

    def valid(chapter, verse):
        return (verse >= 1) & (verse <= last_of(chapter))

    start = F.struct(
        F.lit(True).alias("ok"), F.lit(False).alias("deep"), F.lit(0).cast("long").alias("chapter"),
        F.array().cast(PART).alias("out"),
    )

    def quad(fc, fv, tc, tv):
        return F.struct(fc.alias("fc"), fv.alias("fv"), tc.alias("tc"), tv.alias("tv"))

    def reading(s, p):
        """The range of one section; ``p`` holds its form and numbers, ``s`` the level and chapter carried here."""
        form, deep, carried, one = p["form"], s["deep"], s["chapter"], F.lit(1).cast("long")
        n = [F.get(p["n"], F.lit(i)) for i in range(4)]
        return (
            F.when(form == "#X#", quad(n[0], n[1], n[0], n[1]))
            .when((form == "#") & deep, quad(carried, n[0], carried, n[0]))
            .when(form == "#", quad(n[0], one, n[0], last_of(n[0])))
            .when((form == "#-#") & deep, quad(carried, n[0], carried, n[1]))
            .when(form == "#-#", quad(n[0], one, n[1], last_of(n[1])))
            .when(form == "#X#-#", quad(n[0], n[1], n[0], n[2]))
            .when(form == "#X#-#X#", quad(n[0], n[1], n[2], n[3]))
            .when((form == "#-#X#") & deep, quad(carried, n[0], n[1], n[2]))
            .when(form == "#-#X#", quad(n[0], one, n[1], n[2]))
        )

    def advance(s, p, rng):
        found = rng.isNotNull() & valid(rng["fc"], rng["fv"]) & valid(rng["tc"], rng["tv"])
        ok = s["ok"] & F.coalesce(found, F.lit(False))
        # Every form leaves the chapter its range ends in.
        return F.struct(
            ok.alias("ok"), (s["deep"] | p["form"].contains("X")).alias("deep"), rng["tc"].alias("chapter"),
            F.when(ok, F.concat(s["out"], F.array(rng))).otherwise(s["out"]).alias("out"),
        )

    def step(s, part):
        parsed = F.struct(
            F.regexp_replace(part, "[0-9]+", "#").alias("form"),
            F.transform(F.split(part, "[X-]"), lambda n: n.try_cast("long")).alias("n"),
        )
        return tx.let(parsed, lambda p: tx.let(reading(s, p), lambda rng: advance(s, p, rng)))

    return F.aggregate(parts, start, step, lambda s: F.struct(s["ok"].alias("ok"), s["out"].alias("out")))


def interpretations(tmpl: Column, last_verses: Column, starts: Column) -> Column:
    """Every reading of a template: ``ARRAY<STRUCT<cost, rank, out>>``, the verses it covers and its separator."""
    tried = tx.let(separators(tmpl), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("X"))))

    def ordinal(chapter, verse):
        return F.element_at(starts, chapter.cast("int")) + verse

    def priced(r, c):
        size = lambda q: F.abs(ordinal(q["tc"], q["tv"]) - ordinal(q["fc"], q["fv"])) + 1
        cost = F.aggregate(r["out"], F.lit(0).cast("long"), lambda acc, q: acc + size(q))
        return F.when(r["ok"], F.struct(cost.alias("cost"), F.ascii(c).alias("rank"), r["out"].alias("out")))

    def read(c):
        return tx.let(section_ranges(sections(tmpl, c), last_verses), lambda r: priced(r, c))

    return F.filter(F.transform(tried, read), lambda x: x.isNotNull())


#: A chapter, one separator and a verse, which most passages are: there is one way to read them.
SINGLE = "^ *[0-9]+ *[,;.:&+] *[0-9]+ *$"


def single_verse(passage: Column, last_verses: Column) -> Column:
    """The one range of a passage of the form :data:`SINGLE` as ``ARRAY<STRUCT<fc, fv, tc, tv>>``, null if it is no verse."""
    numbers = F.translate(passage, ",;.:&+ ", ":" * 6)
    number = lambda n, i: F.substring_index(n, ":", i).try_cast("long")
    both = tx.let(numbers, lambda n: F.struct(number(n, 1).alias("c"), number(n, -1).alias("v")))
    last = lambda p: F.try_element_at(last_verses, p["c"].try_cast("int"))
    return tx.let(both, lambda p: F.when((p["v"] >= 1) & (p["v"] <= last(p)), F.array(
        F.struct(p["c"].alias("fc"), p["v"].alias("fv"), p["c"].alias("tc"), p["v"].alias("tv")))))


def ranges_of(passage: Column, book_ord: Column, last_verses: Column, starts: Column) -> Column:
    """The ranges of a passage: of all readings the one covering fewest verses, sorted by begin; empty if none fits."""
    best = tx.let(template(passage), lambda t: F.array_min(interpretations(t, last_verses, starts)))
    out = F.when(passage.rlike(SINGLE), single_verse(passage, last_verses)).otherwise(best["out"])
    bound = lambda q, c, v: refs.ref(book_ord, q[c], q[v])
    found = F.sort_array(F.transform(out, lambda q: refs.ref_range(bound(q, "fc", "fv"), bound(q, "tc", "tv"))))
    return F.coalesce(F.when(passage.rlike("[0-9]"), found), F.array().cast(RANGES))


def by_language(lang: Column | str, build) -> Column:
    """``build(lang)`` for a fixed language, or picked per row where the language is a column."""
    if isinstance(lang, str):
        return build(lang)
    return F.when(lang == "de", build("de")).otherwise(build("en"))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column later filters read without repeating its computation below themselves."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def with_book_chapters(df: DataFrame, chapters: Chapters, how: str) -> DataFrame:
    """Add the maps of a book's chapters; of packed versifications there are 66 rows each, which are broadcast."""
    known = isinstance(chapters, Packed)
    table = chapters.table(df.sparkSession) if known else chapters
    return attach(df, dims.book_chapters(table), ["vers_name", "book_ord"], how, bounded=known)


def with_ranges(df: DataFrame, chapters: Chapters, keep_unread: bool = False) -> DataFrame:
    """Add the ``ranges`` of ``vers_name, book_ord, passage``; rows without any drop out."""
    d = with_book_chapters(df, chapters, "inner")
    ranges = ranges_of(F.col("passage"), F.col("book_ord"), F.col("last_verses"), F.col("starts"))
    d = computed_once(d, "ranges", ranges).drop("last_verses", "starts", "chapter_count")
    return d if keep_unread else d.where(F.size("ranges") > 0)


def find_citations(
    df: DataFrame, chapters: Chapters, text: str = "text", lang: Column | str = "de", vers_name: Column | str = "esv",
    keep_unread: bool = False, recurring: bool = False,
) -> DataFrame:
    """One row per citation of each text: ``begin, end, book_ord, passage, ranges``; the text column is dropped.

    ``keep_unread`` keeps book names whose numbers give no range. ``recurring`` is for short texts, such as single
    citations, of which many are equal: these are read once and the rows joined with what was found, so texts are moved.
    """
    vers = F.lit(vers_name) if isinstance(vers_name, str) else vers_name
    kept = [c for c in df.columns if c not in (text, "vers_name")]
    if recurring:
        read = F.lit(lang) if isinstance(lang, str) else F.when(lang == "de", "de").otherwise("en")
        keys = ["__text", "__lang", "vers_name"]
        rows = df.select(*kept, F.col(text).alias("__text"), read.alias("__lang"), vers.alias("vers_name"))
        # The number of partitions is given: few bytes are much work here.
        once = rows.select(*keys).distinct()
        spark = df.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        once = once.repartition(tasks, *keys).withColumn("__read", F.col("__text"))
        by = lang if isinstance(lang, str) else F.col("__lang")
        found = find_citations(once, chapters, "__read", by, F.col("vers_name"), keep_unread)
        return attach(rows, found, keys).drop("__text", "__lang")
    found = by_language(lang, lambda x: matches(F.col(text), x))
    # Outer, so that no filter on the number of matches runs the pattern a second time.
    d = df.select(*kept, vers.alias("vers_name"), F.inline_outer(found)).where("book_ord is not null")
    return with_ranges(d, chapters, keep_unread)


def reach(text: Column, end: Column, lang: str) -> Column:
    """Offset up to which a position still points at the citation ending at ``end``.

    The word the citation ends in belongs to it, as long as no further word or numbered name begins.
    """
    letters = fixed.LETTERS[lang]
    rest = F.substring(text, end + 1, F.char_length(text))
    char = f"(?!{tx.numbered_name(lang)})(?:[^{letters}]|[{fixed.POSTFIX_LETTERS}])"
    region = F.regexp_replace(F.regexp_extract(rest, f"^(?:{char})*+", 0), f"[{tx.DROPPED}]+$", "")
    word = F.regexp_extract(rest, f"^[^{tx.WS}]*", 0)
    return end + F.least(F.char_length(region), F.char_length(word))


def citation_at(text: Column, index: Column, lang: str) -> Column:
    """The match a character position points at, null if none."""
    # No reach goes beyond the next match, so only the last match that begins before the position can hold it.
    before = F.filter(matches(text, lang), lambda m: m["begin"] <= index)
    last = F.when(F.size(before) > 0, F.element_at(before, -1))
    return tx.let(last, lambda m: F.when(index < F.greatest(m["end"], reach(text, m["end"], lang)), m))


def parse_at(
    df: DataFrame, chapters: Chapters, text: str = "text", index: str = "idx", lang: Column | str = "de",
    vers_name: Column | str = "esv",
) -> DataFrame:
    """Add ``ranges`` and ``origin`` (``begin, end``) of the reference a position points at; empty and null if none."""
    vers = F.lit(vers_name) if isinstance(vers_name, str) else vers_name
    at = by_language(lang, lambda x: citation_at(F.col(text), F.col(index), x))
    d = df.withColumns({"__at": at, "vers_name": vers})
    d = d.withColumn("book_ord", F.col("__at.book_ord"))
    d = with_book_chapters(d, chapters, "left")
    ranges = ranges_of(F.col("__at.passage"), F.col("book_ord"), F.col("last_verses"), F.col("starts"))
    origin = F.when(F.col("__at").isNotNull(), F.struct(F.col("__at.begin").alias("begin"), F.col("__at.end").alias("end")))
    return d.withColumns({"ranges": ranges, "origin": origin}).drop(
        "__at", "last_verses", "starts", "chapter_count", "book_ord"
    )


def name_occurrences(df: DataFrame, text: str = "text", lang: str = "de") -> DataFrame:
    """One row per occurrence of a book name, whether or not numbers follow: ``name, book_ord``."""
    pattern = f"(?=[{tx.first_letters(lang)}])(?>{tx.spelled_name(lang)})"
    d = df.withColumn("name", F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).drop(text)
    return d.withColumn("book_ord", book_of_name(F.col("name"), lang))
