"""Recorded OCR results: one text file per image with ``image``, ``text``, ``word`` and ``layout`` records.

A file is one row (``wholetext``), its records are an array inside it, so words find their line and paragraph text by
array index without a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rects
from ..functions.text import let
from ..operators.extract import computed_once
from ..operators.ocr import SIDES, by_lines, packed, packed_side

MARK = "\uFDD2"
NUMBER, BOX = "-?\\d+", "-?\\d+ -?\\d+ -?\\d+ -?\\d+"
# The record formats.
RECORDS = {
    "image": "^image (\\d+) (\\d+)",
    "text": f"^text ({BOX})(?: (.*))?$",
    "word": f"^word ({BOX}) (-|\\d+)(?: (-|\\d+))(?: (.*))?$",
    "layout": f"^layout ({BOX}) (-.*|{BOX})",
}


def escaped(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    def without(t):
        d = F.replace(t, F.lit("\\\\"), F.lit(MARK))
        for written, plain in (("\\n", "\n"), ("\\r", "\r")):
            d = F.replace(d, F.lit(written), F.lit(plain))
        return F.replace(F.regexp_replace(d, "\\\\(.)", "$1"), F.lit(MARK), F.lit("\\"))

    return let(text, lambda t: F.when(t.contains("\\"), without(t)).otherwise(t))


def _box(numbers: Column) -> Column:
    return let(F.split(numbers, " "), lambda n: rects.rect(*[F.get(n, F.lit(i)) for i in range(4)]))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.ocr").text(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(name, "\\.ocr$", "").alias("image_id"), F.col("value").alias("content"))


def parsed(files: DataFrame) -> DataFrame:
    """``image_id, width, height, texts, records`` of the complete files; a broken record rejects its file."""
    lines = let(F.split("content", "\n"), lambda rows: F.when(F.col("content").contains("\r"), F.transform(
        rows, lambda r: F.regexp_replace(r, "\r$", ""))).otherwise(rows))
    d = computed_once(files.select("image_id", "content"), "lines", lines)
    tagged = lambda r, name: (r == name) | r.startswith(f"{name} ")
    broken = F.exists("lines", lambda r: F.coalesce(*[
        F.when(tagged(r, name) & ~r.rlike(pattern), True) for name, pattern in RECORDS.items()
    ], F.lit(False)))
    of = lambda name: F.filter("lines", lambda r: tagged(r, name))
    image = F.element_at(of("image"), -1)
    texts = F.transform(of("text"), lambda r: F.struct(
        unescaped(F.regexp_extract(r, RECORDS["text"], 2)).alias("text"),
        _box(F.regexp_extract(r, RECORDS["text"], 1)).alias("box"),
    ))
    size = lambda i: F.regexp_extract(image, RECORDS["image"], i).try_cast("int")
    d = d.where(~broken & (F.size(of("image")) > 0))
    return d.select(
        "image_id", size(1).alias("width"), size(2).alias("height"), texts.alias("texts"), of("word").alias("words"),
        of("layout").alias("layouts"),
    ).where("width > 0")


def words(files: DataFrame) -> DataFrame:
    """OCR words ``image_id, word_idx, text, box, line, para`` of parsed files."""
    def word(r, i):
        fields = F.split(r, " ", 8)
        # A hyphen isn't tried as a number: each such failure costs more than all else that is read of a word.
        number = lambda v: F.when(v != "-", v.try_cast("int"))
        at = lambda f, k: F.get(F.col("texts"), number(F.get(f, F.lit(k))))
        # The pattern leaves a character out that ends a line at the end.
        ended = reduce(Column.__or__, [r.endswith(c) for c in "\r\u0085\u2028\u2029"])
        text = lambda f: F.when(ended, F.regexp_extract(r, RECORDS["word"], 4)).otherwise(F.coalesce(F.get(f, F.lit(7)), F.lit("")))
        return let(fields, lambda f: F.struct(
            i.alias("word_idx"), unescaped(text(f)).alias("text"),
            rects.rect(*[F.get(f, F.lit(k)) for k in range(1, 5)]).alias("box"), at(f, 5).alias("line"), at(f, 6).alias("para")))

    # Made inside the row of the file: a row for each word must not take the texts of the file along.
    return files.select("image_id", F.inline(F.transform("words", word)))


def layouts(files: DataFrame) -> DataFrame:
    """``image_id, line_idx, line_box, para_box?`` of parsed files."""
    d = files.select("image_id", F.posexplode("layouts").alias("line_idx", "r"))
    para = F.regexp_extract("r", RECORDS["layout"], 2)
    return d.select(
        "image_id", "line_idx", _box(F.regexp_extract("r", RECORDS["layout"], 1)).alias("line_box"),
        F.when(~para.rlike("^- |^-$"), _box(para)).alias("para_box"),
    )


def _numbered(words: DataFrame) -> DataFrame:
    """``image_id, word_idx, text, box, line_n, para_n``: words with the numbers of their texts, counted by first use.

    Texts are told apart by their digests, so that a word moves once and without the texts it stands in.
    """
    digest = lambda t: F.when(F.col(t).isNotNull(), F.unhex(F.sha2(F.to_json(t), 256)))
    d = words.select("image_id", "word_idx", F.struct("text", "box").alias("w"), F.monotonically_increasing_id().alias("__row"),
                     digest("line").alias("line"), digest("para").alias("para"))
    # A row for the line, missing or not, and one for a paragraph.
    use = lambda k, t, w: F.struct(F.lit(k).alias("k"), t.alias("t"), w.alias("w"))
    para = F.when(F.col("para").isNotNull(), use(1, F.col("para"), F.lit(None).cast(d.schema["w"].dataType)))
    d = d.select("image_id", "word_idx", "__row", F.inline(F.array_compact(F.array(use(0, F.col("line"), F.col("w")), para))))
    d = d.repartition("image_id").withColumn("at", F.when(F.col("t").isNotNull(), F.struct("word_idx", "k")))
    d = d.withColumn("at", F.min("at").over(Window.partitionBy("image_id", "t")))
    d = d.withColumn("n", F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.col("at").asc_nulls_last())) - 1)
    number = lambda k: F.max(F.when((F.col("k") == k) & F.col("t").isNotNull(), F.col("n")))
    d = d.groupBy("image_id", "word_idx", "__row").agg(
        F.first("w", ignorenulls=True).alias("w"), number(0).alias("line_n"), number(1).alias("para_n"))
    return d.select("image_id", "word_idx", "w.text", "w.box", "line_n", "para_n")


def _numbers(box: Column) -> Column:
    return F.concat_ws(" ", *[box[k].cast("string") for k in SIDES])


def _head() -> Column:
    return F.concat_ws(" ", F.lit("image"), "width", "height")


def _layout() -> Column:
    para = F.when(F.col("para_box").isNull(), "- - - -").otherwise(_numbers(F.col("para_box")))
    return F.concat_ws(" ", F.lit("layout"), _numbers(F.col("line_box")), para)


def files(images: DataFrame, words: DataFrame, layouts: DataFrame) -> DataFrame:
    """``image_id, content``: the file of each image, from words or from words by lines (see :mod:`..operators.ocr`).

    All that is said of an image moves once and is gathered once, a line as one row; texts are numbered and records are
    written inside the row of the image, which is as large as its file. The texts of words that are what blanks part in the
    text of their line don't move.
    """
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(
        " ", F.lit("text"), _numbers(F.col(c)["box"]), escaped(F.col(c)["text"])))
    lines = by_lines(words).select(
        "image_id", "first_word", text("line").alias("value"), text("para").alias("para"), packed(F.col("words")).alias("words"),
        F.transform("words", lambda w: F.coalesce(escaped(w["text"]), F.lit(""))).alias("texts"))
    of_record = lambda value: F.slice(F.split(value, " "), 6, 1 << 30)
    moved = F.when(~F.col("texts").eqNullSafe(of_record(F.col("value"))), F.col("texts"))
    lines = lines.select("image_id", F.struct(
        F.lit(1).alias("kind"), F.col("first_word").cast("long").alias("at"), "value", "para", moved.alias("texts"), "words").alias("r"))
    kind = lines.schema["r"].dataType
    alone = lambda n, at, value: F.struct(
        F.lit(n).alias("kind"), at.cast("long").alias("at"), value.alias("value"), F.lit(None).cast("string").alias("para"),
        F.lit(None).cast("array<string>").alias("texts"), F.lit(None).cast(kind["words"].dataType).alias("words")).alias("r")
    d = lines.unionByName(images.select("image_id", alone(0, F.lit(0), _head()))).unionByName(
        layouts.select("image_id", alone(2, F.col("line_idx"), _layout())))
    d = d.groupBy("image_id").agg(F.collect_list("r").alias("r"))
    d = computed_once(d, "r", F.array_sort("r"))
    of = lambda n: F.filter("r", lambda r: r["kind"] == n)
    values = lambda n: F.transform(of(n), lambda r: r["value"])
    d = d.select("image_id", values(0).alias("head"), of(1).alias("lines"), values(2).alias("layout"))
    used = F.flatten(F.transform("lines", lambda r: F.array(r["value"], r["para"])))
    d = computed_once(d, "texts", F.array_distinct(F.array_compact(used)))
    number = lambda t: F.coalesce((F.array_position(F.col("texts"), t) - 1).cast("string"), F.lit("-"))

    def records_of(r):
        numbers = F.concat_ws(" ", number(r["value"]), number(r["para"]))
        word = lambda w, n, t, i: F.concat_ws(
            " ", F.lit("word"), *[packed_side(w, k, i).cast("string") for k in SIDES], n, t)
        texts = F.coalesce(r["texts"], of_record(r["value"]))
        return let(numbers, lambda n: F.transform(texts, lambda t, i: word(r["words"], n, t, i)))

    rows = F.flatten(F.transform("lines", records_of))
    return d.select("image_id", F.array_join(F.concat("head", "texts", rows, "layout"), "\n").alias("content"))


def records(images: DataFrame, words: DataFrame, layouts: DataFrame) -> DataFrame:
    """``image_id, ord, value``: the records of each image in the order of its file.

    Texts are numbered by their first use; an image is as large as a screen.
    """
    used = words.select("image_id", "word_idx", F.posexplode(F.array("line", "para")).alias("k", "t")).where("t is not null")
    first = used.groupBy("image_id", "t").agg(F.min(F.struct("word_idx", "k")).alias("at"))
    w = Window.partitionBy("image_id").orderBy("at")
    index = first.select("image_id", "t", (F.row_number().over(w) - 1).alias("n"))
    head = images.select("image_id", F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")).alias("ord"), _head().alias("value"))
    order = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.col(n).cast("long").alias("n"))
    texts = index.select(
        "image_id", order(1, "n").alias("ord"), F.concat_ws(" ", F.lit("text"), _numbers(F.col("t.box")), escaped(F.col("t.text"))).alias("value")
    )
    d = _numbered(words)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = d.select("image_id", order(2, "word_idx").alias("ord"), F.concat_ws(
        " ", F.lit("word"), _numbers(F.col("box")), shown("line_n"), shown("para_n"), escaped(F.col("text"))
    ).alias("value"))
    layout = layouts.select("image_id", order(3, "line_idx").alias("ord"), _layout().alias("value"))
    return head.unionByName(texts).unionByName(rows).unionByName(layout)


def write_files(spark: SparkSession, recs: DataFrame, folder: str) -> None:
    """One text file per image in a folder ``image_id=…``, its records in order."""
    recs.repartition("image_id").sortWithinPartitions("image_id", "ord").select("image_id", "value").write.mode(
        "overwrite"
    ).partitionBy("image_id").text(folder)
