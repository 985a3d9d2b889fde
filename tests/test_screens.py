import random
import tempfile

import pytest
from pyspark.sql import functions as F

from versewright.operators import ocr
from versewright.streaming import dwell, signals

BOX = "struct<x:int,y:int,w:int,h:int>"
WORDS = f"image_id string, word_idx int, text string, box {BOX}, line struct<text:string,box:{BOX}>, para struct<text:string,box:{BOX}>"
SEARCHES = "image_id string, search_id long, x int, y int"


def screen(image, rows, para=False):
    out, top = [], 50
    for row in rows:
        text, box = " ".join(t for t, _, _ in row), (row[0][1], top, row[-1][1] + row[-1][2] - row[0][1], 20)
        out += [(t, (x, top, w, 20), (text, box)) for t, x, w in row]
        top += 30
    paragraph = ("\n".join(" ".join(t for t, _, _ in r) for r in rows), (0, 50, 400, top - 60)) if para else None
    return [(image, i, t, b, line, paragraph) for i, (t, b, line) in enumerate(out)]


# One line, its last word far away from the others.
GAP = [[("Jona", 12, 58), ("2,3;", 78, 40), ("4,1.", 300, 40)]]
TWO = [[("Siehe", 10, 50), ("Lk", 68, 20), ("3,", 94, 20)], [("16", 10, 20), ("und", 36, 30), ("1.Mose", 72, 60), ("1,1", 138, 30)]]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(screen("gap", GAP) + screen("two", TWO) + screen("para", TWO, True), WORDS)


def test_references_under_positions(spark, chapters, words):
    at = [("gap", 1, 95, 55), ("gap", 2, 210, 60), ("gap", 3, 320, 60), ("two", 4, 70, 55), ("two", 5, 15, 85),
          ("two", 6, 150, 85), ("two", 7, 900, 85), ("para", 8, 15, 85)]
    found = ocr.find_references(words, spark.createDataFrame(at, SEARCHES), chapters).collect()
    got = {r.search_id: [tuple(x["from"]) for x in r.ranges] for r in found}
    assert got == {1: [(32, 2, 3)], 4: [(42, 3, 16)], 5: [(42, 3, 16)], 6: [(1, 1, 1)], 8: [(42, 3, 16)]}
    boxes = {r.search_id: tuple(r.box) for r in found}
    assert boxes[6] == (72, 80, 96, 20) and boxes[4] == (10, 50, 104, 50)


def test_text_and_cursor(spark, words):
    d = ocr.position_texts(words, spark.createDataFrame([("two", 1, 15, 85), ("para", 2, 15, 85)], SEARCHES))
    texts = {r.search_id: (r.text, r.text[r.idx]) for r in d.collect()}
    assert texts == {1: ("Siehe Lk 3, 16 und 1.Mose 1,1 ", "1"), 2: ("Siehe Lk 3, 16 und 1.Mose 1,1", "1")}
    area = d.select(ocr.cursor_lines_area(F.col("found"), F.col("idx")).alias("a")).first().a
    assert area.h == 100 and area.y == 25


def samples(seed, n):
    rnd, rows = random.Random(seed), []
    for key, share in (("hot", 2 * n), ("a", n), ("b", n)):
        x = y = ts = 0.0
        for _ in range(share):
            ts += rnd.choice([250, 250, 300, 4000])
            if rnd.random() < 0.15:
                x, y = rnd.uniform(0, 60), rnd.uniform(0, 60)
            else:
                x, y = x + rnd.uniform(-3, 3), y + rnd.uniform(-3, 3)
            rows.append((key, int(ts), x, y))
    return rows


def fold(rows, dwell_ms, tolerance):
    rests, out = {}, []
    for key, ts, x, y in sorted(rows):
        rest = rests.setdefault(key, dwell.Rest())
        if rest.advance(ts, x, y, dwell_ms, tolerance):
            out.append((key, ts, rest.anchor[0], rest.anchor[1]))
    return sorted(out)


def test_resting_points_of_a_hot_key(spark):
    rows = samples(1, 400)
    d = spark.createDataFrame(rows, "key string, ts long, x double, y double")
    got = dwell.dwells(d, bucket_ms=20_000).select("key", "ts", "anchor_x", "anchor_y").collect()
    assert sorted(map(tuple, got)) == fold(rows, 700, 8)
    assert len(got) > 20


def test_resting_points_stream_equals_batch(spark):
    rows = sorted(samples(2, 200), key=lambda r: r[1])
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "key string, ts long, x double, y double"
    for i, part in enumerate((rows[:300], rows[300:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = dwell.dwells_stream(stream).writeStream.format("memory").queryName("rests").option("checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rests").select("key", "ts", "anchor_x", "anchor_y").collect()
    assert sorted(map(tuple, got)) == fold(rows, 700, 8)


def test_streams_of_signals_are_correlated(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sql("SELECT id AS detection_id, timestamp_seconds(1000 + id) AS detecting_at FROM range(0, 40, 2)").write.parquet(f"{folder}/a")
    spark.sql("SELECT id AS detection_id, timestamp_seconds(1001 + id) AS detected_at FROM range(40)").write.parquet(f"{folder}/b")
    a = spark.readStream.schema("detection_id long, detecting_at timestamp").parquet(f"{folder}/a")
    b = spark.readStream.schema("detection_id long, detected_at timestamp").parquet(f"{folder}/b")
    q = signals.correlate_streams(b, a, "5 seconds").writeStream.format("memory").queryName("pairs").option(
        "checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("pairs").collect()
    assert sorted(r.detection_id for r in rows if r.detecting_at) == list(range(0, 40, 2))


def test_detections_are_shifted_to_the_screen(spark, chapters, words):
    dwells = spark.createDataFrame([("two", 1, 170, 285)], SEARCHES)
    windows = spark.createDataFrame([("two", 20, 200)], "image_id string, origin_x int, origin_y int")
    row = signals.detections(dwells, windows, words, chapters).first()
    assert tuple(row.box) == (92, 280, 96, 20)


def test_boxes_of_any_size_stand_in_four_cells(spark):
    rnd = random.Random(6)
    sizes = [1, 7, 63, 64, 65, 128, 129, 1000, 4096, 100_000]
    boxes = [(f"i{n % 3}", n, {"x": rnd.randint(-500, 3000), "y": rnd.randint(-500, 3000), "w": rnd.choice(sizes), "h": rnd.choice(sizes)}) for n in range(300)]
    boxes += [("i0", 900, {"x": 1, "y": 1, "w": 0, "h": 5})]
    points = [(f"i{n % 4}", n, rnd.randint(-500, 4000), rnd.randint(-500, 4000)) for n in range(200)]
    box_table = spark.createDataFrame(boxes, "image_id string, word_idx int, box struct<x: int, y: int, w: int, h: int>")
    cells = ocr._cells(box_table, F.col("box")).groupBy("word_idx").count()
    assert cells.agg(F.max("count")).first()[0] <= 4
    found = ocr.boxes_at(spark.createDataFrame(points, "image_id string, search_id int, x int, y int"), box_table)
    inside = lambda b, x, y: b["x"] <= x < b["x"] + b["w"] and b["y"] <= y < b["y"] + b["h"]
    want = {(s, w) for image, s, x, y in points for other, w, b in boxes if image == other and inside(b, x, y)}
    assert {(r.search_id, r.word_idx) for r in found.collect()} == want and found.count() == len(want)


def plan(spark, df):
    """The plan without adaptive execution, which shows the shuffles that are used twice."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().sparkSession().sessionState().executePlan(
            df._jdf.queryExecution().logical(), df._jdf.queryExecution().mode()).executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_islands_come_from_one_shuffle_of_the_words(spark, monkeypatch):
    monkeypatch.setattr(ocr, "WIDTH", 8)
    rnd, rows, want = random.Random(5), [], set()
    for image in ("a", "b"):
        line, run, number, before = 0, 0, 0, "none"
        last = None
        for i in range(60):
            line += rnd.random() < 0.2
            at = None if rnd.random() < 0.3 or 16 <= i < 27 else line
            run += before == "none" or at != before
            number += at is not None and at != last
            before, last = at, last if at is None else at
            rows.append((image, i, "x", (i, 0, 5, 5), None if at is None else ("t", (0, at * 30, 9, 9)), None))
            want.add((image, i, run, None if at is None else number))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, WORDS).write.parquet(f"{folder}/words")
    found = ocr.with_islands(spark.read.parquet(f"{folder}/words")).select("image_id", "word_idx", "line_run", "line_no")
    assert {tuple(r) for r in found.collect()} == want
    shown = plan(spark, found)
    assert sum("+- Exchange hashpartitioning" in x and "__b" in x and "Reused" not in x for x in shown.split("\n")) <= 2, shown


def test_a_box_stands_in_one_cell(spark, words):
    cells = ocr._cells(words, F.col("box")).groupBy("image_id", "word_idx").count()
    assert cells.agg(F.max("count")).first()[0] == 1


def test_gaps_are_found_without_gathering_words(spark):
    import __spark_entry__ as entry_points

    assert "Aggregate" not in plan(spark, entry_points.queries()["ocr_wide_gaps"](spark, "/root/testdata/sf0.001"))


def test_words_are_not_joined_with_pointed_at_images(spark, words):
    assert "LeftSemi" not in plan(spark, ocr.position_texts(words, spark.createDataFrame([("two", 1, 15, 85)], SEARCHES)))
