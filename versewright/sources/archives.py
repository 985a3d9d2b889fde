"""Scripture archives: zips to entries, routing, decoding, ingest with stamps, and the verse store.

Unzipping is the one step Spark has no built-in for; it runs per archive inside the tasks that read it.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..operators import versify
from ..operators.skew import attach, union_all
from ..session import written
from . import markup, metadata, snapshots

# An archive, or a part of it, that can't be unzipped has a row with an ``error`` and without content.
ENTRY = "file string, size long, modified long, entry_idx int, entry string, content binary, error string"
# Raised when stored verses change form, so that kept archives are read anew.
STORE_VERSION = 1
# Extensions of the formats, in the order the readers are asked.
FORMATS = [("usfm", (".usfm", ".sfm")), ("usx", (".usx",))]


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, size, modified, path`` of the archives directly in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("ignoreMissingFiles", True).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified"), "path",
    )


def scan_entries(spark: SparkSession, folder: str, only: DataFrame | None = None, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the archives of a folder, folders inside them left out.

    ``only`` restricts the files by name; ``wanted``, endings of entry names, leaves other entries zipped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("ignoreMissingFiles", True).load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified"), "content",
    )
    if only is not None:
        files = attach(files, only.select("file").distinct(), ["file"], "left_semi")
    return files.mapInPandas(_unzipper(wanted), ENTRY)


def _unzipper(wanted: tuple[str, ...]):
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                for found in _unzipped(row.content, wanted):
                    yield pd.DataFrame([(row.file, row.size, row.modified, *found)], columns=names)

    return unzip


def _unzipped(content: bytes, wanted: tuple[str, ...]) -> Iterator[tuple]:
    """``entry_idx, entry, content, error`` of the entries."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield -1, None, None, "no zip archive"
        return
    entries = [i for i in archive.infolist() if not i.filename.endswith("/")]
    if not entries:
        yield -1, None, None, "empty archive"
    for idx, item in enumerate(entries):
        data = error = None
        if item.flag_bits & 1:
            error = f"{item.filename}: encrypted"
        elif not wanted or item.filename.lower().endswith(wanted):
            try:
                data = archive.read(item)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError):
                error = f"{item.filename}: damaged"
        yield idx, item.filename, data, error


def base_name(entry: Column) -> Column:
    return F.lower(F.element_at(F.split(entry, "/"), -1))


def find_entry(entries: DataFrame, file_name: str) -> DataFrame:
    """Per archive the entry of that name closest to the root, the first on a tie."""
    depth = F.size(F.split("entry", "/"))
    return entries.where(base_name(F.col("entry")) == file_name.lower()).groupBy("file").agg(
        F.min_by(F.struct(*[c for c in entries.columns if c != "file"]), F.struct(depth, "entry_idx")).alias("e")
    ).select("file", "e.*")


def decoded(entries: DataFrame) -> DataFrame:
    """Add ``text`` without byte order mark, null for what is no UTF-8."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\uFEFF", "")
    return entries.withColumn("text", text).drop("content")


def format_of(entry: Column) -> Column:
    """Format an entry belongs to by its extension, null for other files."""
    name, result = base_name(entry), F.lit(None).cast("string")
    for fmt, extensions in reversed(FORMATS):
        ends = [name.endswith(x) for x in extensions]
        result = F.when(ends[0] if len(ends) == 1 else ends[0] | ends[1], fmt).otherwise(result)
    return result


def routed(entries: DataFrame) -> DataFrame:
    """Entries of the format each archive is read in: the first reader with a file of its format answers."""
    ranked = entries.withColumn("format", format_of(F.col("entry"))).where("format is not null")
    rank = F.when(F.col("format") == "usfm", 0).otherwise(1)
    chosen = ranked.groupBy("file").agg(F.min_by("format", rank).alias("format"))
    return attach(ranked, chosen, ["file", "format"])


def info_of(entries: DataFrame) -> DataFrame:
    """``file, info`` of every archive: the first info file that reads, else the name of the file."""
    frames = []
    for rank, (file_name, reader) in enumerate(metadata.INFO_FILES):
        found = decoded(find_entry(entries, file_name))
        frames.append(found.select("file", F.lit(rank).alias("rank"), metadata.READERS[reader](F.col("text")).alias("info")))
    read = union_all(frames).where("info is not null").groupBy("file").agg(F.min_by("info", "rank").alias("info"))
    stem = metadata.file_stem(F.col("file"))
    named = attach(entries.select("file").distinct(), read, ["file"], "left")
    return named.select(
        "file", F.coalesce(F.col("info.name"), stem).alias("name"), F.col("info.abbreviation").alias("abbreviation"),
        F.col("info.language").alias("language"), F.col("info.copyright").alias("copyright"),
    )


def read_archives(entries: DataFrame) -> dict[str, DataFrame]:
    """``verses``, ``names``, ``info`` and ``status`` of archives given by their entries.

    ``status`` holds the first error of an archive, null for one that reads; one bad file fails its archive.  The
    verse table is written once, since names, status and the catalog read it too.
    """
    if "error" in entries.columns:
        damaged = entries.where("error is not null").groupBy("file").agg(F.min_by("error", "entry_idx").alias("damage"))
        entries = entries.drop("error")
    else:
        damaged = entries.groupBy("file").agg(F.lit(None).cast("string").alias("damage"))
    found = routed(decoded(entries))
    docs = markup.book_names(markup.documents(found))
    unread = F.when(F.col("flat").isNull(), F.concat_ws(": ", "entry", F.lit("no UTF-8 text"))).otherwise(F.col("error"))
    docs = written(docs.withColumn("error", unread), "documents")
    verses = written(markup.first_file_per_book(markup.verse_rows(docs)), "verses")
    failed = docs.where("error is not null").groupBy("file").agg(F.min_by("error", "entry_idx").alias("error"))
    filled = verses.select("file").distinct().withColumn("__filled", F.lit(True))
    answered = docs.select("file").distinct().withColumn("__answered", F.lit(True))
    status = entries.select("file").distinct()
    for part in (damaged, failed, answered, filled):
        status = attach(status, part, ["file"], "left")
    status = written(status.select("file", F.coalesce(
        "damage", "error", F.when(F.col("__answered").isNull(), "no reader"),
        F.when(F.col("__filled").isNull(), "no book of the app"),
    ).alias("error")), "status")
    readable = status.where("error is null").select("file")
    verses = attach(verses, readable, ["file"], "left_semi")
    used = verses.select("file", "entry_idx", "book_ord").distinct()
    names = docs.join(used, ["file", "entry_idx", "book_ord"], "left_semi").select(
        "file", "book_ord", "abbreviation", "short_name", "long_name"
    )
    info = attach(info_of(entries), readable, ["file"], "left_semi")
    return {"verses": verses.drop("entry_idx"), "names": names, "info": info, "status": status}


def outline(info: DataFrame) -> DataFrame:
    """Scripture information with the defaults of fields a reader left out."""
    return info.withColumns({
        "abbreviation": F.coalesce("abbreviation", F.lit("Unknown Abbreviation")),
        "language": F.coalesce("language", F.lit("")),
    })


def reader_output(names: DataFrame, verses: DataFrame) -> DataFrame:
    """``file, book_names, verse_counts`` as nested maps by book identifier, the exchange form of readers."""
    from ..functions.refs import book_id

    forms = F.create_map(*[x for f in ("abbreviation", "short_name", "long_name") for x in (F.lit(f), F.col(f))])
    by_book = names.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct(book_id(F.col("book_ord")), forms))).alias("book_names")
    )
    ends = verses.groupBy("file", "book_ord", "chapter").agg(F.max("verse").alias("last"))
    per_book = ends.groupBy("file", "book_ord").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "last")))).alias("c")
    )
    counts = per_book.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct(book_id(F.col("book_ord")), "c"))).alias("verse_counts")
    )
    return by_book.join(counts, "file")


def from_reader_output(output: DataFrame) -> DataFrame:
    """Chapter ends ``file, book_ord, chapter, last_verse`` of reader outputs.

    Unknown books and numbers out of range come back with an ``error`` instead of a book.
    """
    d = output.select("file", F.explode("verse_counts").alias("book_id", "c"))
    d = d.select("file", "book_id", F.explode("c").alias("chapter", "last_verse"))
    ids = dims.books(output.sparkSession).select("book_id", "book_ord")
    bad = lambda c: ~F.col(c).between(F.lit(1), F.lit(4294967295))
    error = F.when(F.col("book_ord").isNull(), F.concat(F.lit("unknown book: book="), F.col("book_id"))).when(
        bad("chapter") | bad("last_verse"), F.lit("invalid chapter or verse number")
    )
    return attach(d, ids, ["book_id"], "left").withColumn("error", error)


# --- catalog names ----------------------------------------------------------------------------------------------------------


def named(files: DataFrame) -> DataFrame:
    """``file, name`` to catalog names: a name taken before, in file order, gets the next ``(n)`` of its own.

    Per name the number is a running count raised by numbered names written out in the files, both ordinary windows.
    Names are resolved by how many suffixes they end with, as a name can only be taken by one with fewer.
    """
    # A number up to uint32.
    larger = "[1-3]\\d{9}|4[01]\\d{8}|42[0-8]\\d{7}|429[0-3]\\d{6}|4294[0-8]\\d{5}|42949[0-5]\\d{4}|429496[0-6]\\d{3}|4294967[01]\\d{2}|42949672[0-8]\\d|429496729[0-5]"
    number_text = f"(?:0|[1-9]\\d{{0,8}}|{larger})"
    suffix = f" \\(({number_text})\\)$"
    depth = F.size(F.split(F.regexp_extract("name", f"((?: \\({number_text}\\))*)$", 1), "\\)")) - 1
    d = files.select("file", "name", depth.alias("depth"))
    levels = d.agg(F.max("depth")).first()[0] or 0
    taken, results = None, []
    for level in range(levels + 1):
        raw = d.where(F.col("depth") == level).select("file", "name", F.lit(0).alias("gen"), F.lit(0).cast("long").alias("n"))
        # Numbered names written out: they raise the count of their base.
        literal = d.where(F.col("depth") == level + 1).select(
            "file", F.regexp_replace("name", suffix, "").alias("name"), F.lit(2).alias("gen"),
            F.regexp_extract("name", suffix, 1).try_cast("long").alias("n"),
        )
        rows = raw.unionByName(literal)
        if taken is not None:
            rows = rows.unionByName(taken.select("file", "name", F.lit(1).alias("gen"), F.lit(0).cast("long").alias("n")))
        w = Window.partitionBy("name").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy("name").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
        own = F.col("gen") == 0
        seen = F.coalesce(F.sum(F.when(F.col("gen") < 2, 1).otherwise(0)).over(w), F.lit(0))
        rows = rows.withColumn("dup", own & (seen > 0))
        rows = rows.withColumn("d", F.sum(F.col("dup").cast("int")).over(upto))
        raised = F.max(F.when(F.col("gen") == 2, F.col("n") - F.col("d"))).over(upto)
        number = F.col("d") + F.greatest(F.coalesce(raised, F.lit(0)), F.lit(0))
        shown = F.when(F.col("dup"), F.concat("name", F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(F.col("name"))
        level_names = rows.withColumn("catalog_name", shown).where(own)
        results.append(level_names.select("file", "name", "catalog_name"))
        # Names given out here may be written out in a later file of the next level.
        taken = level_names.where("dup").select("file", F.col("catalog_name").alias("name"))
    return union_all(results)


# --- the store ----------------------------------------------------------------------------------------------------------------


def write_verses(verses: DataFrame, path: str) -> None:
    """Replace the stored verses of the scriptures in ``verses``; those of others stay."""
    (
        verses.repartition("scripture", "book_ord").sortWithinPartitions("book_ord", "chapter", "verse")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scripture").parquet(path)
    )


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def passage(verses: DataFrame, scripture: str, book_ord: int, chapter: int, verse: int) -> DataFrame:
    """One verse of the store: a partition and a pushed-down filter."""
    return verses.where(
        (F.col("scripture") == scripture) & (F.col("book_ord") == book_ord) & (F.col("chapter") == chapter)
        & (F.col("verse") == verse)
    )


def stamped(files: DataFrame) -> DataFrame:
    return files.withColumn("stamp", F.concat_ws("|", F.lit(STORE_VERSION), "size", "modified"))


def changed(files: DataFrame, manifest: DataFrame, reload: bool = False) -> DataFrame:
    """Files to read: new ones and those whose stamp is not the kept one; all of them on ``reload``."""
    d = stamped(files)
    return d if reload else attach(d, manifest.select("file", "stamp"), ["file", "stamp"], "left_anti")


def vanished(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Kept files the folder no longer holds."""
    return attach(manifest, files.select("file"), ["file"], "left_anti")


def load(
    spark: SparkSession, folder: str, store: str, reload: bool = False,
    reader: Callable[[DataFrame], dict[str, DataFrame]] = read_archives,
) -> DataFrame:
    """Bring the store up to date with a folder and return the status of the archives read.

    Only changed archives are read, each unzipped once. An archive that does not read keeps its old verses but leaves the
    catalog, and is tried again the next time; a vanished one leaves both. The tables ``verses``, ``names`` and ``info``
    change together (:mod:`.snapshots`); where nothing has changed there is no new version.
    """
    store = store.rstrip("/")
    before = snapshots.current(spark, store)
    kept = snapshots.manifest(spark, store, before)
    files = written(scan_files(spark, folder), "files")
    todo = written(changed(files, kept, reload), "changed")
    gone = written(vanished(files, kept).select("file"), "gone")
    endings = tuple(x for _, extensions in FORMATS for x in extensions) + tuple(name.lower() for name, _ in metadata.INFO_FILES)
    out = reader(written(scan_entries(spark, folder, todo, endings), "entries"))
    status = written(out["status"], "status")
    if todo.isEmpty() and gone.isEmpty():
        return status
    readable = status.where("error is null").select("file")

    def rows(load_id: str) -> DataFrame:
        new = attach(todo.select("file", "stamp"), readable, ["file"], "left_semi")
        new = new.select("file", "stamp", F.lit(load_id).alias("load"), F.lit(True).alias("listed"))
        stay = attach(attach(kept, todo.select("file"), ["file"], "left_anti"), gone, ["file"], "left_anti")
        old = attach(attach(kept, todo.select("file"), ["file"], "left_semi"), readable, ["file"], "left_anti")
        old = old.select("file", F.lit(None).cast("string").alias("stamp"), "load", F.lit(False).alias("listed"))
        return new.unionByName(stay).unionByName(old)

    snapshots.commit(spark, store, before, {t: out[t] for t in ("verses", "names", "info")}, rows)
    return status


def store_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """``verses`` (by ``scripture``, the file), ``names`` or ``info`` of the current version of a store."""
    rows = snapshots.read(spark, store.rstrip("/"), table)
    return rows.withColumnRenamed("file", "scripture") if table == "verses" else rows


def import_archives(
    spark: SparkSession, source: str, folder: str, reader: Callable[[DataFrame], dict[str, DataFrame]] = read_archives
) -> int:
    """Copy the archives of ``source`` that read into ``folder``, replacing equal names; returns how many.

    Nothing is copied from the folder itself or from within it. Hadoop copies file by file, between any file systems.
    """
    (origin, origin_system), (target, target_system) = snapshots.hadoop_path(spark, source), snapshots.hadoop_path(spark, folder)
    inside = origin if origin_system.getFileStatus(origin).isDirectory() else origin.getParent()
    if inside.equals(target):
        return 0
    status = reader(scan_entries(spark, source))["status"].where("error is null").select("file")
    copied = 0
    for row in written(status, "accepted").toLocalIterator():
        one = spark._jvm.org.apache.hadoop.fs.Path(inside, row.file)
        place = spark._jvm.org.apache.hadoop.fs.Path(target, row.file)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
            origin_system, one, target_system, place, False, True, spark._jsc.hadoopConfiguration())
        copied += 1
    return copied


def catalog(info: DataFrame) -> DataFrame:
    """Scriptures of the store under their catalog names."""
    return attach(outline(info), named(info.select("file", "name")).select("file", "catalog_name"), ["file"])


def versifications(verses: DataFrame, spark: SparkSession) -> DataFrame:
    """The versification of every archive, lacking books filled from the closest default."""
    return versify.derive(
        verses.withColumnRenamed("file", "scripture"), dims.books(spark), dims.versification(spark)
    )
