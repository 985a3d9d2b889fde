"""Ranges to citations and lookup URLs: scripture resolution, verse text, names, masks and links.

Tables: ``verses(scripture, book_ord, chapter, verse, markup, cross_references)``,
``scriptures(scripture, abbreviation, language, copyright, source)`` and
``scripture_books(scripture, book_ord, abbreviation, short_name, long_name)``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import mask as masks
from ..functions import refs
from ..functions import text as tx
from ..session import shared_folder
from . import versify
from .packed import Packed
from .skew import attach
from .versify import Chapters

VERSE = ["scripture", "book_ord", "chapter", "verse"]


# --- which scripture a request means -------------------------------------------------------------------------------------


def resolve(requests: DataFrame, scriptures: DataFrame, default: str | None) -> DataFrame:
    """Add ``selected`` (the requested name or the default), its ``source`` and ``error`` if it does not exist.

    ``scriptures`` holds ``scripture, source`` with source ``file`` or ``script``; a file shadows a script scripture
    of its name.
    """
    sources = scriptures.groupBy(F.col("scripture").alias("selected")).agg(F.min("source").alias("source"))
    d = requests.withColumn("selected", F.coalesce("scripture", F.lit(default).cast("string")))
    d = attach(d, sources, ["selected"], "left")
    return d.withColumn("error", F.when(F.col("source").isNull(), "scripture not found"))


def passages(requests: DataFrame, scriptures: DataFrame, verses: DataFrame, default: str | None) -> DataFrame:
    """The verse of each request ``scripture?, book_ord, chapter, verse``: its markup or an error.

    Point lookups by the thousand: one equi-join on the partition column and the verse.
    """
    d = resolve(requests, scriptures, default)
    found = verses.select(
        F.col("scripture").alias("selected"), *VERSE[1:], "markup", "cross_references"
    ).withColumn("__found", F.lit(True))
    d = attach(d, found, ["selected", *VERSE[1:]], "left")
    missing = F.when(F.col("__found").isNull(), "verse not found")
    return d.withColumn("error", F.coalesce("error", missing)).drop("__found")


def catalog(file_scriptures: DataFrame, script_scriptures: DataFrame) -> DataFrame:
    """All scriptures by name, those of files shadowing those of scripts."""
    shown = attach(script_scriptures, file_scriptures.select("scripture"), ["scripture"], "left_anti")
    return (
        file_scriptures.withColumn("source", F.lit("file"))
        .unionByName(shown.withColumn("source", F.lit("script")), allowMissingColumns=True)
    )


def with_information(df: DataFrame, scriptures: DataFrame) -> DataFrame:
    """Add ``scripture_abbr, language, copyright`` of ``scripture``, empty where it has none."""
    info = scriptures.select("scripture", F.col("abbreviation").alias("scripture_abbr"), "language", "copyright")
    d = attach(df, info, ["scripture"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("scripture_abbr", "language", "copyright")})


def named_books(scripture_books: DataFrame) -> DataFrame:
    """Book names with empty strings for the forms left out; a book without any name is none."""
    forms = ["abbreviation", "short_name", "long_name"]
    some = F.coalesce(*forms).isNotNull()
    return scripture_books.where(some).withColumns({f: F.coalesce(f, F.lit("")) for f in forms})


def with_book_names(df: DataFrame, scripture_books: DataFrame, book: str = "book_ord", suffix: str = "") -> DataFrame:
    """Add the three name forms of the book in column ``book``; null for a book without names."""
    names = named_books(scripture_books).select(
        "scripture", F.col("book_ord").alias(book),
        *[F.col(f).alias(f + suffix) for f in ("abbreviation", "short_name", "long_name")],
    )
    return attach(df, names, ["scripture", book], "left")


def display_name(short: Column, abbreviation: Column, long: Column, book_ord: Column) -> Column:
    """The name a book is shown with: short, abbreviation, long, else its identifier."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(short, empty), F.nullif(abbreviation, empty), F.nullif(long, empty), refs.book_id(book_ord)
    )


def reading_rows(context: DataFrame, verses: DataFrame, scripture_books: DataFrame) -> DataFrame:
    """Rows of a reading view from :func:`versify.context_window`: verse text, book name and chapter headers.

    Verse 1 carries the header of its chapter.
    """
    d = context.withColumns({
        "book_ord": F.col("context.book_ord"), "chapter": F.col("context.chapter"), "verse": F.col("context.verse"),
    })
    d = attach(d, verses.select(*VERSE, "markup", "cross_references"), VERSE, "left")
    d = with_book_names(d, scripture_books)
    shown = display_name(F.col("short_name"), F.col("abbreviation"), F.col("long_name"), F.col("book_ord"))
    return d.withColumns({"chapter_header": F.col("verse") == 1, "book_name": shown}).drop(
        "short_name", "abbreviation", "long_name"
    )


def cross_reference_edges(
    verses: DataFrame, chapters: Chapters, lang: Column | str, vers_name: Column | str = "kjv"
) -> DataFrame:
    """``verse -> cited range`` edges from the cross-reference texts of verses."""
    from .extract import find_citations

    notes = verses.select(*VERSE, F.explode("cross_references").alias("text"))
    found = find_citations(
        notes.withColumnsRenamed({"book_ord": "src_book", "chapter": "src_chapter", "verse": "src_verse"}),
        chapters, "text", lang, vers_name,
    )
    return found.select("scripture", "src_book", "src_chapter", "src_verse", F.explode("ranges").alias("range"))


# --- verse text of ranges --------------------------------------------------------------------------------------------------


def joined_text(verses: Column, numbered: bool) -> Column:
    """Texts of ``ARRAY<STRUCT<verse, plain>>`` joined by a space, empty ones left out, optionally with their number."""
    filled = F.filter(verses, lambda v: v["plain"] != "")
    text = lambda v: F.concat_ws(" ", v["verse"].cast("string"), v["plain"]) if numbered else v["plain"]
    return F.array_join(F.transform(filled, text), " ")


def stored_by_chapter(verses: DataFrame, buckets: int) -> DataFrame:
    """Verses written as a table in buckets of chapters, sorted, in the shared folder; joins by chapter don't move its rows.

    ``buckets`` is chosen for the size of the store: a bucket is what one task reads.
    """
    spark = verses.sparkSession
    name = f"verses_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    chapter = ["scripture", "book_ord", "chapter"]
    verses.repartition(buckets, *chapter).write.bucketBy(buckets, *chapter).sortBy(*chapter).saveAsTable(name, format="parquet", path=path)
    return spark.table(name)


def contents(ranges: DataFrame, verses: DataFrame, chapters: Chapters) -> DataFrame:
    """``content`` and ``content_numbered`` per distinct ``scripture, vers_name, range``; null if a verse is missing.

    Equal requests are answered once.  Verses are gathered by chapter (176 at most) and stand at their number there, ranges are
    split by chapter and cut their piece, which is joined before it moves; so a range costs one row per chapter, not per verse.
    Only the chapters asked for are gathered, and of a table stored by :func:`stored_by_chapter` they are gathered where they stand.
    """
    keys = ["scripture", "vers_name", "range"]
    chapter = ["scripture", "book_ord", "chapter"]
    parts = versify.split_by_chapter(ranges.select(*keys).distinct(), chapters)
    parts = parts.select(
        *keys, F.col("part.from.book_ord").alias("book_ord"), F.col("part.from.chapter").alias("chapter"),
        F.col("part.from.verse").alias("first"), F.col("part.to.verse").alias("last"),
    )
    asked = attach(verses.select(*VERSE, "markup"), parts.groupBy(*chapter).agg(F.max("last").alias("most")), chapter)
    asked = asked.where(F.col("verse").between(1, F.col("most")))
    texts = asked.select(*VERSE, "most", tx.markup_to_plain(F.col("markup")).alias("plain")).groupBy(*chapter).agg(
        F.array_sort(F.collect_list(F.struct("verse", "plain"))).alias("v"), F.max("most").alias("most"))
    until = lambda i: F.size(F.filter("v", lambda v: v["verse"] <= i))
    # A verse without text is null, which is left out where texts are joined.
    shown = lambda numbered: F.transform(F.sequence(F.lit(1), "most"), lambda i: F.nullif(
        joined_text(F.filter("v", lambda v: v["verse"] == i), numbered), F.lit("")))
    texts = texts.select(*chapter, F.transform(F.sequence(F.lit(0), "most"), until).alias("held"), shown(False).alias("plain"), shown(True).alias("numbered"))
    d = attach(parts, texts, chapter, "left")
    size = F.col("last") - F.col("first") + 1
    piece = lambda c: F.array_join(F.slice(c, F.col("first"), size), " ")
    d = d.select(*keys, *chapter[1:], piece("plain").alias("plain"), piece("numbered").alias("numbered"), F.coalesce(
        F.get("held", F.col("last")) - F.get("held", F.col("first") - 1) == size, F.lit(False)).alias("complete"))
    # Gathered apart, so that the one nobody reads is never made.
    in_order = lambda c: F.array_sort(F.collect_list(F.struct(*chapter[1:], F.col(c).alias("t"))))
    gathered = d.groupBy(*keys).agg(
        F.bool_and("complete").alias("complete"), in_order("plain").alias("plain"), in_order("numbered").alias("numbered"))
    text = lambda c: F.when(F.col("complete"), F.array_join(F.filter(F.col(c)["t"], lambda t: t != ""), " "))
    return gathered.select(*keys, text("plain").alias("content"), text("numbered").alias("content_numbered"))


def citations(
    df: DataFrame, mask: str, scriptures: DataFrame, scripture_books: DataFrame, verses: DataFrame,
    chapters: Chapters,
) -> DataFrame:
    """Add ``citation`` for every ``scripture, vers_name, range``; null where a verse is missing or nothing is left.

    Verses are joined only if the mask shows their text, book names of the end only if it names them.
    """
    d = with_information(df, scriptures)
    d = d.withColumns({"__b": F.col("range.from.book_ord"), "__e": F.col("range.to.book_ord")})
    d = with_book_names(d, scripture_books, "__b")
    ends = named_books(scripture_books).select(
        "scripture", F.col("book_ord").alias("__e"), F.col("short_name").alias("__end_name")
    )
    d = attach(d, ends, ["scripture", "__e"], "left") if "[book_end]" in mask else d.withColumn("__end_name", F.lit(""))
    texts = {
        "book": F.col("short_name"), "book_long": F.col("long_name"), "book_abbr": F.col("abbreviation"),
        "book_end": F.col("__end_name"), "scripture": F.col("scripture"), "scripture_abbr": F.col("scripture_abbr"),
        "copyright": F.col("copyright"),
    }
    complete = F.lit(True)
    if masks.needs_content(mask):
        d = attach(d, contents(df, verses, chapters), ["scripture", "vers_name", "range"], "left")
        texts |= {"content": F.col("content"), "content_numbered": F.col("content_numbered")}
        complete = F.col("content").isNotNull()
    rendered = masks.render(mask, masks.values_of(F.col("range"), texts))
    d = d.withColumn("citation", F.when(complete, F.nullif(rendered, F.lit(""))))
    return d.select(*df.columns, "citation")


# --- lookup sites -----------------------------------------------------------------------------------------------------------


def percent_encoded(text: Column) -> Column:
    """Letters, digits and ``.-_~`` as they are, everything else as UTF-8 bytes in hexadecimal."""
    encoded = F.url_encode(text)
    for written, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def choose_translations(chosen: Column, language: Column, provider: str) -> Column:
    """The chosen translations the site offers, else its defaults for the language."""
    names = fixed.BIBLE_COM if provider == "bible_com" else fixed.BIBLESERVER
    offered = [row[0] for row in names]
    known = F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda t: t.isin(offered))
    defaults = F.array().cast("array<string>")
    for lang, translations in fixed.LOOKUP_DEFAULTS[provider].items():
        defaults = F.when(language == lang, F.array(*map(F.lit, translations))).otherwise(defaults)
    return F.when(F.size(known) > 0, known).otherwise(defaults)


def _verses(first: Column, last: Column) -> Column:
    return F.when(last > first, F.concat(first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(
        first.cast("string")
    )


def lookup_url(provider: str, translations: Column, book_ord: Column, chapter: Column, first: Column, last: Column) -> Column:
    """URL of verses of one chapter at a lookup site, null without a known translation or book."""
    book = lambda names: F.get(F.array(*[F.lit(n) for n in names]), book_ord - 1)
    if provider == "bible_com":
        by_name = {n: (v, a) for n, v, a in fixed.BIBLE_COM}
        known = F.get(F.filter(translations, lambda t: t.isin(list(by_name))), F.lit(0))
        pick = lambda i: F.element_at(
            F.create_map(*[F.lit(x) for n, row in by_name.items() for x in (n, str(row[i]))]), known
        )
        passage = F.concat_ws(
            ".", book([c for _, c in fixed.BOOKS]), chapter.cast("string"), _verses(first, last), pick(1)
        )
        url = F.concat(F.lit("https://www.bible.com/bible/"), pick(0), F.lit("/"), passage)
        return F.when(known.isNotNull() & book_ord.between(1, 66), url)
    abbreviations = dict(fixed.BIBLESERVER)
    table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
    known = F.filter(translations, lambda t: t.isin(list(abbreviations)))
    names = F.array_join(F.transform(known, lambda t: percent_encoded(F.element_at(table, t))), ".")
    url = F.concat(
        F.lit("https://www.bibleserver.com/"), names, F.lit("/"),
        percent_encoded(book([fixed.bibleserver_book(i) for i in range(1, 67)])), chapter.cast("string"),
        F.lit("%2C"), _verses(first, last),
    )
    return F.when((F.size(known) > 0) & book_ord.between(1, 66), url)


def is_web_url(url: Column) -> Column:
    """Whether a text is a URL of http or https with a host."""
    protocol, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.lower(protocol).isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), F.lit(False))


def lookup_urls(df: DataFrame, provider: str, chapters: Chapters, translations: str = "translations") -> DataFrame:
    """One row per chapter of each ``range`` with its ``url``; web pages count like the KJV, one book at a time.

    ``provider`` is a packaged site or a registered function of the same arguments as :func:`lookup_url`.
    """
    kjv = chapters if isinstance(chapters, Packed) else chapters.where("vers_name = 'kjv'")
    d = df.withColumns({"__range": refs.one_book(F.col("range")), "vers_name": F.lit("kjv")})
    d = versify.split_by_chapter(d, kjv, "__range").drop("__range", "vers_name")
    part = F.col("part")
    args = (
        F.col(translations), part["from"]["book_ord"], part["from"]["chapter"], part["from"]["verse"],
        part["to"]["verse"],
    )
    url = provider(*args) if callable(provider) else lookup_url(provider, *args)
    return d.withColumn("url", url).where(is_web_url(F.col("url")))

