import pytest
from pyspark.sql import functions as F

from versewright.functions import refs
from versewright.operators import cite
from versewright.operators.packed import packaged


def paths_to_scans(plan, above=()):
    """Names of the nodes above each scan, from the top down."""
    children = plan.children()
    names = (*above, plan.nodeName())
    if not children.size():
        yield names, plan.simpleString(1000)
    for i in range(children.size()):
        yield from paths_to_scans(children.apply(i), names)


@pytest.fixture(scope="module")
def verses(spark):
    d = spark.range(40).select(
        F.lit("A").alias("scripture"), F.lit(1).alias("book_ord"), (F.floor(F.col("id") / 20) + 1).cast("int").alias("chapter"),
        (F.col("id") % 20 + 1).cast("int").alias("verse"), F.concat(F.lit("<p>v"), "id", F.lit("</p>")).alias("markup"))
    return cite.stored_by_chapter(d.where("not (chapter = 2 and verse = 5)"), 4)


def ranges(spark, *pairs):
    d = spark.createDataFrame([("A", *a, *b) for a, b in pairs], "scripture string, c1 int, v1 int, c2 int, v2 int")
    rng = refs.ref_range(refs.ref(F.lit(1), "c1", "v1"), refs.ref(F.lit(1), "c2", "v2"))
    return d.select("scripture", F.lit("kjv").alias("vers_name"), rng.alias("range"))


def test_contents_of_a_stored_table(spark, verses):
    found = cite.contents(ranges(spark, ((1, 2), (1, 4)), ((2, 1), (2, 3)), ((2, 4), (2, 6))), verses, packaged())
    by_range = {(r.range["from"].chapter, r.range["from"].verse): (r.content, r.content_numbered) for r in found.collect()}
    assert by_range == {(1, 2): ("v1 v2 v3", "2 v1 3 v2 4 v3"), (2, 1): ("v20 v21 v22", "1 v20 2 v21 3 v22"), (2, 4): (None, None)}


def test_stored_verses_are_not_moved(spark, verses):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cite.contents(ranges(spark, ((1, 2), (1, 4))), verses, packaged())._jdf.queryExecution().executedPlan()
        scans = [names for names, text in paths_to_scans(plan) if "markup" in text]
        assert len(scans) == 1
        joins = [i for i, name in enumerate(scans[0]) if "SortMergeJoin" in name or "ShuffledHashJoin" in name]
        # Below the join with the ranges, and the one that leaves only the chapters asked for, nothing is exchanged.
        assert len(joins) == 2 and "Exchange" not in scans[0][joins[0]:]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_contents_by_brute_force(spark):
    rows = [("A", 1, c, v, text) for c, last in ((1, 31), (2, 25), (3, 24)) for v in range(1, last + 1)
            for text in [["<p></p>", None, f"<p>t{c}.{v}</p>"][min(v % 7, 2)]] if (c, v) != (2, 20)]
    rows += [("A", 1, 1, 500_000_000, "<p>beyond</p>")]
    verses = spark.createDataFrame(rows, "scripture string, book_ord int, chapter int, verse int, markup string")
    order = [(c, v) for c, last in ((1, 31), (2, 25), (3, 24)) for v in range(1, last + 1)]
    pairs = [(order[i], order[j]) for i in range(0, 80, 3) for j in range(i, 80, 7)]
    held = {(c, v): m for _, _, c, v, m in rows}
    wanted = {}
    for a, b in pairs:
        covered = order[order.index(a):order.index(b) + 1]
        filled = [(v, held[c, v][3:-4]) for c, v in covered if held.get((c, v)) not in (None, "<p></p>")]
        whole = (" ".join(t for _, t in filled), " ".join(f"{v} {t}" for v, t in filled))
        wanted[a, b] = whole if all(x in held for x in covered) else (None, None)
    found = cite.contents(ranges(spark, *pairs), verses, packaged())
    place = lambda r: (r.chapter, r.verse)
    assert {(place(r.range["from"]), place(r.range["to"])): (r.content, r.content_numbered) for r in found.collect()} == wanted


def test_verses_are_joined_before_they_move(spark, verses):
    plan = cite.contents(ranges(spark, ((1, 2), (1, 4))), verses, packaged())._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan
