"""Words by lines: the same results as words alone, and only what is pointed at moves."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from versewright.operators import ocr, skew
from versewright.sources import captures

BOX = "struct<x:int,y:int,w:int,h:int>"
TEXT = f"struct<text:string,box:{BOX}>"
WORDS = f"image_id string, word_idx int, text string, box {BOX}, line {TEXT}, para {TEXT}"
LINES = f"image_id string, first_word int, last_word int, line {TEXT}, para {TEXT}, words array<struct<word_idx:int,text:string,box:{BOX}>>"


def screens():
    """Words of odd screens: lines with a word without a line inside, split lines, words that stand out, no lines at all."""
    rnd, out = random.Random(11), []
    for image in range(8):
        at = 0
        for n in range(9):
            texts = [rnd.choice(["Joh", "3,16", "und", "x y", "a\\n", "", "Lk", "2,3"]) for _ in range(rnd.randint(1, 6))]
            line = (" ".join(texts), (0, n * 30, 400, 20)) if image % 4 != 3 or n % 2 else None
            para = ("\n".join(["Absatz", *texts]), (0, n // 3 * 90, 400, 80)) if image % 4 == 1 and n < 6 else None
            for i, t in enumerate(texts):
                at += rnd.choice([1, 1, 3])
                x = 40_000 if rnd.random() < 0.05 else i * 70
                own = None if rnd.random() < 0.1 else line
                out.append((f"i{image}", at, t, (x, n * 30, rnd.choice([0, 30, 65]), 20), own, para))
    return out


def by_lines(rows):
    out = []
    for image, i, t, box, line, para in rows:
        # A line of three words goes on in a row of its own.
        if not out or out[-1][0] != image or out[-1][3:5] != [line, para] or len(out[-1][5]) == 3:
            out.append([image, i, i, line, para, []])
        out[-1][2] = i
        out[-1][5].append((i, t, box))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = screens()
    return rows, spark.createDataFrame(rows, WORDS), spark.createDataFrame([tuple(r) for r in by_lines(rows)], LINES)


def searches(spark):
    rnd = random.Random(5)
    at = [(f"i{n % 9}", n, rnd.choice([*(rnd.randint(-5, 420) for _ in range(5)), 40_010]), rnd.randint(-5, 280)) for n in range(240)]
    return at, spark.createDataFrame(at, "image_id string, search_id long, x int, y int")


def inside(b, x, y):
    return b[0] <= x < b[0] + b[2] and b[1] <= y < b[1] + b[3]


def test_cursor_words_by_lines(spark, tables):
    rows, words, lines = tables
    at, frame = searches(spark)
    want = {}
    for image, s, x, y in at:
        own = [r for r in rows if r[0] == image]
        hit = [r[1] for r in own if inside(r[3], x, y)] or [r[1] for r in own if r[4] and inside(r[4][1], x, y)]
        if hit:
            want[s] = min(hit)
    for given in (words, lines):
        assert {r.search_id: r.cursor_word for r in ocr.cursor_words(given, frame).collect()} == want
    assert len(want) > 60


def around(own, cursor):
    """The text at a word of a screen and the words it is from, as the engine's results tell."""
    row = next(r for r in own if r[1] == cursor)
    shown = lambda t: t.replace("\n", " ").replace("\r", " ")
    k = own.index(row)
    if row[5]:
        a, b = k, k
        while a and own[a - 1][5] and own[a - 1][5][1] == row[5][1]:
            a -= 1
        while b + 1 < len(own) and own[b + 1][5] and own[b + 1][5][1] == row[5][1]:
            b += 1
        return [(shown(row[5][0]), own[a:b + 1])]
    if not row[4]:
        return [(shown(row[2]), [row])]
    spans = []
    for r in own:
        if r[4]:
            if not spans or spans[-1][0][4][1] != r[4][1]:
                spans.append([r, r])
            spans[-1][1] = r
    n = next(i for i, (a, b) in enumerate(spans) if a[1] <= cursor <= b[1])
    return [(a[4][0].rstrip("\r\n") + " ", [r for r in own if a[1] <= r[1] <= b[1]]) for a, b in spans[max(n - 1, 0):n + 2]]


def test_position_texts_by_lines(spark, tables):
    rows, words, lines = tables
    at, frame = searches(spark)
    cursors = {r.search_id: r.cursor_word for r in ocr.cursor_words(words, frame).collect()}
    want = {}
    for image, s, _, _ in at:
        if s in cursors:
            text, found = "", []
            for run, members in around([r for r in rows if r[0] == image], cursors[s]):
                start = 0
                for r in members:
                    p = run.find(r[2], start) if r[2] else -1
                    if p >= 0:
                        found.append((r[1], len(text) + p))
                        start = p + len(r[2])
                text += run
            want[s] = text, found
    got = []
    for given in (words, lines):
        d = ocr.position_texts(given, frame).collect()
        got.append({r.search_id: (r.text, [(f.word_idx, f.begin) for f in r.found], r.idx) for r in d})
    assert got[0] == got[1] and len(got[0]) > 40
    assert all(want[s] == (text, found) for s, (text, found, _) in got[0].items())


def test_captures_by_lines_are_read_back(spark, tables):
    rows, words, lines = tables
    images = words.select("image_id").distinct().withColumns({"width": F.lit(10), "height": F.lit(20)})
    layout = spark.createDataFrame([("i1", 0, (0, 0, 9, 9), None)], f"image_id string, line_idx int, line_box {BOX}, para_box {BOX}")
    want, index = set(), {}
    for image, _, t, box, line, para in rows:
        index[image] = index.get(image, -1) + 1
        want.add((image, index[image], t, box, line, para))
    for given in (words, lines):
        files = captures.files(images, given, layout)
        parsed = captures.parsed(files)
        both = lambda t: t and (t.text, tuple(t.box))
        assert {(r.image_id, r.word_idx, r.text, tuple(r.box), both(r.line), both(r.para)) for r in captures.words(parsed).collect()} == want
        assert [r.image_id for r in captures.layouts(parsed).collect()] == ["i1"]


def test_words_of_captures_do_not_take_the_texts_along(spark):
    files = spark.createDataFrame([("a", "image 1 1\ntext 0 0 9 9 x\nword 1 2 3 4 0 - x")], "image_id string, content string")
    plan = captures.words(captures.parsed(files))._jdf.queryExecution().sparkPlan().toString()
    (beside,) = re.findall(r"\), \[([^\]]*)\], false, \[word_idx", plan)
    assert re.fullmatch(r"image_id#\d+", beside), beside


def test_rows_that_may_be_wanted(spark):
    rows = spark.range(200_000).select((F.col("id") % 1000).cast("string").alias("a"), F.col("id").cast("int").alias("b"))
    wanted = rows.where("b % 997 = 0").select("a", F.col("b").cast("long").alias("b"))
    kept = skew.likely(rows, ["a", "b"], wanted)
    assert kept.columns == rows.columns and kept.where("b % 997 = 0").count() == wanted.count()
    assert kept.count() < 1.1 * wanted.count() + 10


def test_no_texts_are_stored_for_positions(spark):
    import __spark_entry__ as entry_points

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared) for f in files)
    before = size()
    assert entry_points.queries()["ocr_text_at_position"](spark, "/root/testdata/sf0.01").count() == 3315
    assert size() - before < 2 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")
