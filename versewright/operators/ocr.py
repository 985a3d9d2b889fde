"""From OCR words and pointed-at positions to the references under them.

``words``: ``image_id, word_idx, text, box, line STRUCT<text, box>?, para STRUCT<text, box>?`` in reading order, or the same
by lines: ``image_id, first_word, last_word, line, para, words ARRAY<STRUCT<word_idx, text, box>>``, a row for consecutive
words of one line and paragraph, which spares the texts of lines in every word.
``searches``: ``image_id, search_id, x, y``, a ``search_id`` being unique over all images.

Positions meet boxes through grids of cells, one for each size of boxes, so a position is compared with the boxes of its
own cells only.  Lines and
paragraphs of an image are islands found by bucketed windows (:mod:`.skew`), so one image may hold any share of the
words.  Boxes of lines are what moves; words only where a position is near (:func:`.skew.fetched`).  What is gathered per
search is the text around one position: a paragraph or three lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rects
from ..functions import text as tx
from ..session import written
from . import extract
from .skew import attach, fetched, islands
from .versify import Chapters

CELL = 64
WIDTH = 4096  # words of one image per window group


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / (F.lit(CELL) * F.pow(F.lit(2), level))).cast("int")


def _cells(df: DataFrame, box: Column) -> DataFrame:
    """The cell each box begins in, in the grid of its level, whose cells are as large as the box at least."""
    d = df.where((box["w"] > 0) & (box["h"] > 0))
    size = F.greatest(box["w"], box["h"]) / F.lit(CELL)
    d = d.withColumn("level", F.greatest(F.ceil(F.log2(size)), F.lit(0)).cast("int"))
    return d.withColumns({"cx": _cell(box["x"], F.col("level")), "cy": _cell(box["y"], F.col("level"))})


def boxes_at(searches: DataFrame, boxes: DataFrame, box: str = "box") -> DataFrame:
    """Equi-join of positions with the boxes containing them.

    A box holds positions of the cell it begins in and of the next ones at most, so a position probes four cells of each
    level that its image has boxes of, some 25 levels at most whatever the boxes are.
    """
    kept = [c for c in boxes.columns if c != "image_id"]
    held = boxes.select("image_id", F.struct(*kept).alias("__held"))
    cells = _cells(held, F.col("__held")[box])
    levels = cells.groupBy("image_id").agg(F.collect_set("level").alias("__levels"))
    d = attach(searches, levels, ["image_id"]).withColumn("level", F.explode("__levels")).drop("__levels")
    for c, at in (("cx", "x"), ("cy", "y")):
        d = d.withColumn(c, _cell(F.col(at), F.col("level"))).withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c))))
    d = attach(d, cells, ["image_id", "level", "cx", "cy"]).where(rects.contains(F.col("__held")[box], F.col("x"), F.col("y")))
    return d.select(*searches.columns, *[F.col("__held")[c].alias(c) for c in kept])


def by_lines(words: DataFrame) -> DataFrame:
    """Rows of consecutive words of one line and paragraph: ``image_id, first_word, last_word, line, para, words``.

    A line may be several rows; those without a line have so many words that none is large.
    """
    columns = ["image_id", "first_word", "last_word", "line", "para", "words"]
    if "words" in words.columns:
        return words.select(*columns)
    same = {"__run": (F.struct("line", "para"), lambda prev, cur: ~prev.eqNullSafe(cur))}
    d = islands(words.select("image_id", "word_idx", "text", "box", "line", "para"), ["image_id"], "word_idx", WIDTH, same)
    d = d.groupBy("image_id", "__run", F.floor(F.col("word_idx") / WIDTH).alias("__b")).agg(
        F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"),
        F.min_by("line", "word_idx").alias("line"), F.min_by("para", "word_idx").alias("para"),
        F.array_sort(F.collect_list(F.struct("word_idx", "text", "box"))).alias("words"),
    )
    return written(d.select(*columns), "lines")


#: Fields of words and of located words that move as arrays of numbers, which are small, instead of nested rows.
FIELDS = {
    "word_idx": lambda w: w["word_idx"], "text": lambda w: w["text"], "begin": lambda w: w["begin"], "n": lambda w: w["n"],
    "x": lambda w: w["box"]["x"], "y": lambda w: w["box"]["y"], "w": lambda w: w["box"]["w"], "h": lambda w: w["box"]["h"],
}
SIDES = ("x", "y", "w", "h")


def packed(items: Column, *names: str) -> Column:
    """The named fields and the box of an array of words as a row of arrays; a missing box has no sides.

    A side that fits stands in two bytes; ``wide`` has those of all words of an array in which one doesn't.
    """
    sides = lambda n, kind: F.transform(items, lambda w: FIELDS[n](w).try_cast(kind))
    large = F.exists(items, lambda w: F.coalesce(F.greatest(*[F.abs(FIELDS[n](w).cast("long")) for n in SIDES]) > 32767, F.lit(False)))
    return F.struct(
        *[F.transform(items, FIELDS[n]).alias(n) for n in names], *[sides(n, "smallint").alias(n) for n in SIDES],
        F.when(large, F.struct(*[sides(n, "int").alias(n) for n in SIDES])).alias("wide"))


def packed_side(columns: Column, name: str, i: Column) -> Column:
    return F.coalesce(F.get(columns[name], i).cast("int"), F.get(columns["wide"][name], i))


def _unpacked(columns: Column, *names: str) -> Column:
    def item(i):
        box = F.struct(*[packed_side(columns, n, i).alias(n) for n in SIDES])
        return F.struct(*[F.get(columns[n], i).alias(n) for n in names[:2]], box.alias("box"), *[F.get(columns[n], i).alias(n) for n in names[2:]])

    return F.transform(columns[names[0]], lambda _, i: item(i))


def _within(box: Column, outer: Column) -> Column:
    return (box["x"] >= outer["x"]) & (box["y"] >= outer["y"]) & (box["x"] + box["w"] <= outer["x"] + outer["w"]) & (
        box["y"] + box["h"] <= outer["y"] + outer["h"])


def outlines(lines: DataFrame) -> DataFrame:
    """``image_id, first_word, line, para, outside`` of lines: their boxes and those of words that stand out."""
    boxed = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["box"].alias("box"))).alias(c)
    outside = F.filter("words", lambda w: ~F.coalesce(_within(w["box"], F.col("line.box")), F.lit(False)))
    return lines.select(
        "image_id", "first_word", boxed("line"), boxed("para"), F.transform(outside, lambda w: w["box"]).alias("outside"))


def _cursors(lines: DataFrame, outlined: DataFrame, searches: DataFrame) -> DataFrame:
    """The cursor word of each search with the ``first_word`` of its row of ``lines`` and whether that has a paragraph."""
    key = ["image_id", "search_id", "x", "y"]
    of_line = F.when(F.col("line.box").isNotNull(), F.array("line.box")).otherwise(F.array().cast(f"array<{rects.BOX}>"))
    boxes = outlined.select("image_id", "first_word", F.explode(F.concat(of_line, "outside")).alias("box"))
    near = written(boxes_at(searches.select(*key), boxes).select(*key, "first_word").distinct(), "near")
    key_ = ["image_id", "first_word"]
    given = F.col("para").isNotNull().alias("has_para")
    d = fetched(near, lines, key_, F.col("line.box").alias("line"), given, packed(F.col("words"), "word_idx").alias("words"))
    held = lambda w, i: rects.contains({n: packed_side(F.col("words"), n, i) for n in SIDES}, F.col("x"), F.col("y"))
    d = d.select(*key, "first_word", "line", "has_para", F.array_min(F.filter(
        F.transform(F.col("words.word_idx"), lambda w, i: F.when(held(w, i), w)), lambda w: w.isNotNull())).alias("held"))
    choice = lambda level, word: F.struct(
        F.lit(level).alias("level"), word.alias("cursor_word"), F.col("first_word"), F.col("has_para"))
    best = F.when(F.col("held").isNotNull(), choice(0, F.col("held"))).when(
        rects.contains(F.col("line"), F.col("x"), F.col("y")), choice(1, F.col("first_word")))
    d = d.groupBy(*key).agg(F.min(best).alias("best")).where("best is not null")
    return d.select(*key, "best.cursor_word", "best.first_word", "best.has_para")


def cursor_words(words: DataFrame, searches: DataFrame) -> DataFrame:
    """``search_id, word_idx``: the first word containing a position, else the first word whose line contains it."""
    lines = by_lines(words)
    return _cursors(lines, written(outlines(lines), "outlines"), searches).drop("first_word", "has_para")


def with_islands(words: DataFrame, order: str = "word_idx", around: bool = False) -> DataFrame:
    """Add ``line_no`` (over the words with a line), ``line_run`` and ``para_run`` (over all words).

    A run ends where the box changes or is missing, a line only where another line begins; with ``around`` there is
    ``line_no_around`` too, which numbers words without a line inside a line.
    """
    changes = lambda prev, cur: ~prev.eqNullSafe(cur)
    line = F.col("line.box")
    return islands(words, ["image_id"], order, WIDTH, {
        "line_run": (line, changes), "para_run": (F.col("para.box"), changes),
        "line_no": (F.when(F.col("line").isNotNull(), F.struct(line.alias("box"))), changes),
    }, skipping=("line_no",), around=("line_no",) if around else ())


FOUND = "array<struct<word_idx:bigint,begin:int,box:struct<x:int,y:int,w:int,h:int>,n:int>>"


def _parts(lines: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``image_id, kind, number, rows, texts``: what ``wanted (image_id, kind, number)`` names, gathered and located once.

    Of kind 0 is a line with the words inside it, of 1 a paragraph, of 2 a row without either. ``rows`` has the ends and the
    run of each row; ``texts`` the text of the line or the texts that rows give for the paragraph, with the words found.
    """
    key = ["image_id", "kind", "number"]
    part = lambda kind, number: F.struct(F.lit(kind).alias("kind"), F.col(number).cast("long").alias("number"))
    parts = F.array(part(0, "line_no_around"), part(1, "para_run"), part(2, "first_word"))
    runs = runs.select("image_id", "first_word", F.col("line_no").isNotNull().alias("has_line"), "line_run", F.inline(parts))
    members = written(fetched(wanted, runs, key), "members")
    d = fetched(members, lines, ["image_id", "first_word"], "last_word", F.col("line.text").alias("line_text"),
                F.col("para.text").alias("para_text"), packed(F.col("words"), "word_idx", "text").alias("words"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).alias(c)
    rows = F.array_sort(F.collect_list(F.struct(
        "first_word", "last_word", "has_line", "line_run", of(0, "line_text"), of(1, "para_text"), "words")))
    d = d.groupBy(*key).agg(rows.alias("rows"))
    of_line = F.filter("rows", lambda r: r["has_line"])
    d = d.withColumns({"__begin": F.get(of_line, F.lit(0))["first_word"], "__end": F.try_element_at(of_line, F.lit(-1))["last_word"]})
    inside = F.filter("rows", lambda r: (F.col("kind") != 0) | r["first_word"].between(F.col("__begin"), F.col("__end")))
    d = d.where((F.col("kind") != 0) | F.col("__begin").isNotNull()).withColumn("rows", inside)
    ended = lambda t: F.concat(F.regexp_replace(t, "[\\r\\n]+$", ""), F.lit(" "))
    shown = F.when(F.col("kind") == 0, F.array(ended(F.get("rows", F.lit(0))["line_text"]))).when(
        F.col("kind") == 1, F.array_distinct(F.transform("rows", lambda r: _shown(r["para_text"]))))
    d = d.withColumns({"__shown": shown, "__words": F.flatten(F.transform("rows", lambda r: _unpacked(r["words"], "word_idx", "text")))})
    text = lambda t, w: F.struct(t.alias("text"), tx.let(located_words(w, t), lambda f: packed(f, "word_idx", "begin", "n")).alias("found"))
    found = F.transform("__shown", lambda t: text(t, F.col("__words")))
    alone = F.transform("__words", lambda w: tx.let(_shown(w["text"]), lambda t: text(t, F.array(w))))
    at = lambda r: F.when(F.col("kind") == 1, F.array_position(F.col("__shown"), _shown(r["para_text"]))).otherwise(1)
    ends = F.transform("rows", lambda r: F.struct(
        r["first_word"].alias("first_word"), r["last_word"].alias("last_word"), r["line_run"].alias("line_run"),
        at(r).cast("int").alias("text")))
    return d.select(*key, ends.alias("rows"), F.when(F.col("kind") == 2, alone).otherwise(found).alias("texts"))


def _shown(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def located_words(run_words: Column, run_text: Column) -> Column:
    """``ARRAY<STRUCT<word_idx, begin, box, n>>``: the words found in a run, each behind the one before it."""
    start = F.struct(F.lit(1).alias("from"), F.array().cast(FOUND).alias("out"))

    def step(s, w):
        n = F.char_length(w["text"])
        at = F.when(n > 0, F.position(w["text"], run_text, s["from"])).otherwise(0)
        return tx.let(at, lambda p: F.when(p > 0, F.struct(
            (p + n).alias("from"),
            F.concat(s["out"], F.array(F.struct(
                w["word_idx"].cast("long").alias("word_idx"), (p - 1).alias("begin"), w["box"].alias("box"), n.alias("n")
            ))).alias("out"),
        )).otherwise(s))

    return F.aggregate(run_words, start, step, lambda s: s["out"])


def position_texts(words: DataFrame, searches: DataFrame) -> DataFrame:
    """Per search the text around its position, its located words and the cursor character.

    ``image_id, search_id, x, y, text, found ARRAY<STRUCT<word_idx, begin, box, n>>, idx``; searches that point
    nowhere are left out.  The text is the paragraph if the engine reports one, else the line with its neighbours, else the
    word alone.
    """
    key = ["image_id", "search_id", "x", "y"]
    lines = by_lines(words)
    outlined = written(outlines(lines), "outlines")
    cursors = written(_cursors(lines, outlined, searches), "cursors")
    runs = with_islands(outlined.select("image_id", "first_word", "line", "para"), "first_word", around=True)
    runs = written(runs.drop("line", "para"), "islands")
    cursors = fetched(cursors, runs, ["image_id", "first_word"]).withColumn("has_line", F.col("line_no").isNotNull())
    part = lambda kind, number: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"))
    near = lambda step, when: F.when(F.col("has_line") & when, part(0, F.col("line_no") + step))
    parts = F.array_compact(F.array(
        near(-1, ~F.col("has_para")), near(0, F.lit(True)), near(1, ~F.col("has_para")),
        F.when(F.col("has_para"), part(1, F.col("para_run"))),
        F.when(~F.col("has_para") & ~F.col("has_line"), part(2, F.col("first_word")))))
    cursors = written(cursors.select(*key, "cursor_word", "first_word", "line_run", "has_line", "has_para", F.inline(parts)), "cursors")
    at = ["image_id", "kind", "number"]
    d = attach(cursors, _parts(lines, runs, written(cursors.select(*at).distinct(), "parts")), at)
    # The words of the cursor's line: of its run, or the word alone.
    own = F.filter("rows", lambda r: (F.col("kind") == 0) & F.col("has_line") & (r["line_run"] == F.col("line_run")))
    row = F.get(F.filter("rows", lambda r: r["first_word"] == F.col("first_word")), F.lit(0))
    alone = F.filter("texts", lambda t: F.get(t["found"]["word_idx"], F.lit(0)) == F.col("cursor_word"))
    text = F.when(F.col("kind") == 0, F.when(~F.col("has_para"), F.get("texts", F.lit(0)))).when(
        F.col("kind") == 1, F.get("texts", row["text"] - 1)).otherwise(F.get(alone, F.lit(0)))
    d = d.select(*key, "cursor_word", F.get(own, F.lit(0))["first_word"].alias("focus_first"),
                 F.try_element_at(own, F.lit(-1))["last_word"].alias("focus_last"), F.when(text.isNotNull(), F.struct("number", text.alias("t"))).alias("run"))
    d = d.groupBy(*key).agg(
        F.coalesce(F.min("focus_first"), F.min("cursor_word")).alias("focus_first"),
        F.coalesce(F.max("focus_last"), F.min("cursor_word")).alias("focus_last"), F.sort_array(F.collect_list("run")).alias("runs"),
    ).where(F.size("runs") > 0)
    start = F.struct(F.lit("").alias("text"), F.array().cast(FOUND).alias("found"))

    def join(s, r):
        shifted = F.transform(_unpacked(r["t"]["found"], "word_idx", "begin", "n"), lambda f: F.struct(
            f["word_idx"].alias("word_idx"), (f["begin"] + F.char_length(s["text"])).alias("begin"),
            f["box"].alias("box"), f["n"].alias("n"),
        ))
        return F.struct(F.concat(s["text"], r["t"]["text"]).alias("text"), F.concat(s["found"], shifted).alias("found"))

    d = d.withColumn("t", F.aggregate("runs", start, join))
    d = d.select(*key, F.col("t.text").alias("text"), F.col("t.found").alias("found"), "focus_first", "focus_last")
    focus = F.filter("found", lambda f: f["word_idx"].between(F.col("focus_first"), F.col("focus_last")))
    distances = F.flatten(F.transform(focus, lambda f: F.transform(
        rects.character_boxes(f["box"], f["n"]),
        lambda b, i: F.struct(rects.centre_distance(b, F.col("x"), F.col("y")).alias("d"), (f["begin"] + i).alias("i")),
    )))
    d = d.withColumn("idx", F.array_min(distances)["i"]).drop("focus_first", "focus_last")
    return d.where("idx is not null")


RUN = "struct<begin:int,end:int,box:struct<x:int,y:int,w:int,h:int>>"


def _run(begin: Column, end: Column, box: Column) -> Column:
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"), box.alias("box"))


def characters(found: Column) -> Column:
    """``ARRAY<STRUCT<char_idx, word_idx, box>>`` of located words."""
    return F.flatten(F.transform(found, lambda f: F.transform(
        rects.character_boxes(f["box"], f["n"]),
        lambda b, i: F.struct((f["begin"] + i).alias("char_idx"), f["word_idx"].alias("word_idx"), b.alias("box")),
    )))


def character_runs(found: Column) -> Column:
    """``ARRAY<STRUCT<begin, end, box>>``: runs of consecutive located characters; words without a gap join up.

    The box of a word is that of its characters, whose width is a whole number.
    """
    def step(runs, f):
        width = (F.floor(f["box"]["w"] / f["n"]) * f["n"]).cast("int")
        box = rects.rect(f["box"]["x"], f["box"]["y"], width, f["box"]["h"])
        last = F.get(runs, F.size(runs) - 1)
        joined = _run(last["begin"], f["begin"] + f["n"], rects.unite(last["box"], box))
        return F.when(
            F.coalesce(last["end"] == f["begin"], F.lit(False)),
            F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(joined)),
        ).otherwise(F.concat(runs, F.array(_run(f["begin"], f["begin"] + f["n"], box))))

    return F.aggregate(found, F.array().cast(f"array<{RUN}>"), step)


def run_lines(runs: Column) -> Column:
    """Runs as lines ``ARRAY<ARRAY<run>>``: the next run stays if it starts further right and overlaps vertically."""
    def step(lines, r):
        line = F.get(lines, F.size(lines) - 1)
        last = F.get(line, F.size(line) - 1)["box"]
        same = (last["x"] < r["box"]["x"]) & rects.overlaps(
            last["y"], last["y"] + last["h"], r["box"]["y"], r["box"]["y"] + r["box"]["h"]
        )
        return F.when(
            F.coalesce(same, F.lit(False)),
            F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(line, F.array(r)))),
        ).otherwise(F.concat(lines, F.array(F.array(r))))

    return F.aggregate(runs, F.array().cast(f"array<array<{RUN}>>"), step)


def lower_median(values: Column) -> Column:
    """The middle value, of two the lower one."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def line_gaps(line: Column) -> Column:
    """``ARRAY<STRUCT<before, after, gap>>`` between the neighbouring runs of a line."""
    n = F.size(line)
    return F.zip_with(
        F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), n),
        lambda a, b: F.struct(
            a.alias("before"), b.alias("after"), (b["box"]["x"] - a["box"]["x"] - a["box"]["w"]).cast("double").alias("gap")
        ),
    )


def gap_threshold(line: Column) -> Column:
    """The typical gap of a line plus its typical character width; null for fewer than three runs."""
    width = lambda r: r["box"]["w"] / (r["end"] - r["begin"])
    typical = lower_median(F.transform(line_gaps(line), lambda g: g["gap"])) + lower_median(F.transform(line, width))
    return F.when(F.size(line) >= 3, typical)


def wide_gaps(lines: Column, begin: Column, end: Column) -> Column:
    """Gaps next to ``[begin, end)`` that are wider than the threshold of their line."""
    touches = lambda r: rects.overlaps(r["begin"], r["end"], begin, end)
    of_line = lambda line: tx.let(gap_threshold(line), lambda t: F.filter(
        line_gaps(line), lambda g: (g["gap"] > t) & (touches(g["before"]) | touches(g["after"]))
    ))
    near = F.filter(lines, lambda line: rects.overlaps(
        F.get(line, F.lit(0))["begin"], F.get(line, F.size(line) - 1)["end"], begin, end
    ))
    return F.flatten(F.transform(near, of_line))


def consecutive(gaps: Column, x: Column, y: Column, size: Column) -> Column:
    """``STRUCT<begin, end>``: what wide gaps leave of a text of ``size`` around a position; empty inside a gap.

    Every gap only narrows the range, so their order does not matter.
    """
    def sides(g):
        before, after = g["before"], g["after"]
        around = rects.unite(before["box"], after["box"])
        on_line = (y >= around["y"]) & (y < around["y"] + around["h"])
        ahead = F.when(on_line, x < before["box"]["x"] + before["box"]["w"]).otherwise(y < around["y"])
        behind = F.when(on_line, x >= after["box"]["x"]).otherwise(y >= around["y"] + around["h"])
        return F.struct(
            F.when(~ahead & behind, after["begin"]).otherwise(0).alias("begin"),
            F.when(ahead, before["end"]).when(behind, size).otherwise(0).alias("end"),
        )

    placed = F.transform(gaps, sides)
    return tx.let(placed, lambda p: F.when(F.size(p) == 0, F.struct(F.lit(0).alias("begin"), size.alias("end"))).otherwise(
        F.struct(
            F.array_max(F.transform(p, lambda r: r["begin"])).alias("begin"),
            F.array_min(F.transform(p, lambda r: r["end"])).alias("end"),
        )
    ))


def find_references(
    words: DataFrame, searches: DataFrame, chapters: Chapters, lang: str = "de", vers_name: str = "esv"
) -> DataFrame:
    """``search_id, ranges, box`` of every search with a reference under its position.

    The text around the position is parsed; where a wide gap shows that text was dropped next to the reference, only
    the consecutive characters are parsed again.  ``box`` surrounds the characters the reference was read from.
    From the gathered text on everything happens inside the row.
    """
    d = position_texts(words, searches)
    d = extract.computed_once(d, "m", extract.citation_at(F.col("text"), F.col("idx"), lang))
    begin, end = F.coalesce("m.begin", F.lit(0)), F.coalesce("m.end", F.lit(0))
    lines = run_lines(character_runs(F.col("found")))
    size = F.char_length("text")
    d = extract.computed_once(d, "keep", consecutive(wide_gaps(lines, begin, end), F.col("x"), F.col("y"), size))
    cut = (F.col("keep.begin") > 0) | (F.col("keep.end") < size)
    rest = tx.blank_outside(F.col("text"), F.col("keep.begin"), F.col("keep.end"))
    again = F.when(cut, extract.citation_at(rest, F.col("idx"), lang)).otherwise(F.col("m"))
    d = extract.computed_once(d, "m", again).where("m is not null")
    d = d.select(
        "search_id", "found", F.lit(vers_name).alias("vers_name"), F.col("m.book_ord").alias("book_ord"),
        F.col("m.passage").alias("passage"), F.struct("m.begin", "m.end").alias("origin"),
    )
    d = extract.with_ranges(d, chapters)
    return d.select("search_id", "ranges", bounding_box(F.col("found"), F.col("origin")).alias("box"))


def bounding_box(found: Column, origin: Column) -> Column:
    """The rectangle around the characters of located words inside ``[begin, end)``."""
    inside = F.filter(characters(found), lambda c: (c["char_idx"] >= origin["begin"]) & (c["char_idx"] < origin["end"]))
    return F.aggregate(inside, F.lit(None).cast(rects.BOX), lambda acc, c: rects.unite(acc, c["box"]))


def cascade(passes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Results of recognition passes in order: the first pass that found something answers a search.

    Each pass holds only searches with a result, so a later one adds what the earlier ones lack.
    """
    tagged = passes[0].withColumn("pass", F.lit(0))
    for number, result in enumerate(passes[1:], 1):
        tagged = tagged.unionByName(result.withColumn("pass", F.lit(number)))
    values = [c for c in tagged.columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.min_by(F.struct(*values), "pass").alias("r")).select(*keys, "r.*")


# --- areas to recognize ----------------------------------------------------------------------------------------------------


def cursor_lines_area(found: Column, idx: Column) -> Column:
    """The line of the cursor with its neighbours in the same column, padded by half their height; null off any line."""
    areas = F.transform(run_lines(character_runs(found)), lambda line: F.struct(
        F.aggregate(line, F.lit(None).cast(rects.BOX), lambda acc, r: rects.unite(acc, r["box"])).alias("box"),
        ((F.get(line, F.lit(0))["begin"] <= idx) & (idx < F.get(line, F.size(line) - 1)["end"])).alias("holds"),
    ))

    def around(a):
        at = F.array_position(F.transform(a, lambda line: line["holds"]), F.lit(True)).cast("int")
        cursor = F.get(a, at - 1)["box"]
        near = F.filter(
            F.slice(a, F.greatest(at - 1, F.lit(1)), F.least(at + 1, F.size(a)) - F.greatest(at - 1, F.lit(1)) + 1),
            lambda line: rects.overlaps(
                line["box"]["x"], line["box"]["x"] + line["box"]["w"], cursor["x"], cursor["x"] + cursor["w"]
            ),
        )
        united = F.aggregate(near, F.lit(None).cast(rects.BOX), lambda acc, line: rects.unite(acc, line["box"]))
        return F.when(at > 0, tx.let(united, lambda u: rects.padded(u, u)))

    return tx.let(areas, around)


def layout_area(layout: DataFrame, searches: DataFrame) -> DataFrame:
    """``search_id, area`` from a layout ``image_id, line_idx, line_box, para_box?``.

    The line a position falls in with the lines above and below in the same paragraph, padded by half its height; a
    line without a paragraph alone.  The neighbours come by equi-join on the line number.
    """
    hit = boxes_at(searches, layout.select("image_id", "line_idx", F.col("line_box").alias("box"), "para_box")).groupBy(
        "image_id", "search_id"
    ).agg(F.min_by(F.struct("line_idx", "box", "para_box"), "line_idx").alias("l"))
    d = hit.select("image_id", "search_id", "l.*")
    for step in (-1, 1):
        other = layout.select(
            "image_id", (F.col("line_idx") - step).alias("line_idx"), F.col("line_box").alias("__box"),
            F.col("para_box").alias("__para"),
        )
        d = attach(d, other, ["image_id", "line_idx"], "left")
        same = F.col("__para") == F.col("para_box")
        d = d.withColumn(f"near{step}", F.when(same, F.col("__box")).otherwise(F.col("box"))).drop("__box", "__para")
    area = rects.unite(rects.unite(F.col("near-1"), F.col("box")), F.col("near1"))
    chosen = F.when(F.col("para_box").isNull(), F.col("box")).otherwise(rects.padded(area, F.col("box")))
    return d.select("image_id", "search_id", chosen.alias("area"))

