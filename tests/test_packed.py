import random

import pytest
from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.functions import refs
from versewright.operators import versify
from versewright.operators.packed import Packed, packaged
from versewright.plans import pipelines

FACTS = "id long, vers_name string, book_ord int, chapter int, verse int"


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["esv", "kjv", "none", None]), rnd.choice([None, 0, 67, *range(1, 67)]), rnd.choice([None, -1, *range(0, 60)]),
             rnd.choice([None, *range(-1, 40)])) for i in range(3000)]
    rows += [(5000, "esv", 64, 1, 15), (5001, "kjv", 64, 1, 15), (5002, "kjv", 66, 22, 21), (5003, "esv", 1, 1, 1)]
    return spark.createDataFrame(rows, FACTS)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("operator", ["verse_count", "valid_only", "with_validity", "clamp", "to_ordinals", "neighbours", "context_window"])
def test_single_references_as_by_join(facts, chapters, operator):
    f = getattr(versify, operator)
    if operator == "clamp":
        facts = facts.where("vers_name in ('esv', 'kjv') and book_ord is not null and chapter is not null and verse is not null")
    same(f(facts, packaged()), f(facts, chapters))


@pytest.mark.parametrize("operator", ["range_size", "split_by_chapter", "expand", "with_bounds"])
def test_ranges_as_by_join(facts, chapters, operator):
    a = refs.ref("book_ord", "chapter", "verse")
    b = refs.ref("book_ord", F.col("chapter") + F.col("id") % 3, F.lit(2))
    d = facts.where("id >= 5000 or id % 7 = 0").select("id", "vers_name", refs.ref_range(a, b).alias("range"))
    f = getattr(versify, operator)
    same(f(d, packaged()), f(d, chapters))


def test_ordinals_of_every_verse(spark, chapters):
    every = dims.verse_index(chapters).select("vers_name", "verse_ord")
    outside = spark.createDataFrame([("esv", 0), ("esv", 31104), ("kjv", 31103), ("none", 5), (None, 5), ("esv", None)], "vers_name string, verse_ord int")
    d = every.unionByName(outside)
    same(versify.from_ordinals(d, packaged()), versify.from_ordinals(d, chapters))


def test_pages_as_by_join(spark, chapters):
    d = spark.createDataFrame([("esv", 5, 9), ("kjv", 1, 1), ("kjv", 31100, 31102), ("none", 1, 1)], "vers_name string, first_ord int, last_ord int")
    for forward in (True, False):
        same(versify.page(d, packaged(), 4, forward), versify.page(d, chapters, 4, forward))


def test_facts_are_not_moved(spark, facts):
    a = refs.ref("book_ord", "chapter", "verse")
    d = facts.withColumn("range", refs.ref_range(a, a))
    p = packaged()
    window = d.select("id", "vers_name", F.lit(1).alias("first_ord"), F.lit(3).alias("last_ord"))
    for plan in (
        versify.with_validity(d, p), versify.clamp(d, p), versify.range_size(d, p), versify.split_by_chapter(d, p), versify.expand(d, p),
        versify.context_window(d, p), versify.neighbours(d, p), versify.page(window, p, 3),
    ):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text
    counts = pipelines.citation_counts(spark.createDataFrame([("Joh 3,16",)], "text string"))
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_packing_a_table(spark, chapters):
    assert Packed.of(chapters).tables == packaged().tables
    with pytest.raises(ValueError):
        Packed.of(chapters.where("not (book_ord = 1 and chapter = 2)"))
    with pytest.raises(ValueError):
        Packed({str(k): [[1]] * 66 for k in range(17)})
    with pytest.raises(ValueError):
        Packed({"short": [[1]]})


def test_ties_go_to_the_first_listed_default(spark, chapters):
    ends = spark.createDataFrame([("a", 1, 1, 31), ("b", 64, 1, 14), ("c", 1, 1, 999)], "scripture string, book_ord int, chapter int, last_verse int")
    found = {r.scripture: r.closest for r in versify.closest_default(ends, chapters, ("kjv", "esv")).collect()}
    assert found == {"a": "kjv", "b": "kjv", "c": "kjv"}
    found = {r.scripture: r.closest for r in versify.closest_default(ends, chapters).collect()}
    assert found == {"a": fixed.VERSIFICATIONS[0], "b": "kjv", "c": fixed.VERSIFICATIONS[0]}


def test_a_window_searches_no_chapter_for_each_verse(facts):
    plan = versify.context_window(facts, packaged())._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("\n", plan.index("Generate"))]
    assert "aggregate(" not in above


def test_ordinals_by_windows(spark):
    books = lambda lasts: [lasts] + [[1]] * 65
    own = Packed({"a": books([1, 1, 40, 2, 3, 31, 33]), "b": books([5])})
    asked = spark.range(-2, 300).selectExpr("id as verse_ord", "explode(array('a', 'b', 'none', null)) as vers_name")
    found = versify.from_ordinals(asked, own)
    same(found, versify.from_ordinals(asked, own.table(spark)))
    # Looked up in the row without exploding a list of one.
    assert "Generate" not in versify.from_ordinals(asked.localCheckpoint(), own)._jdf.queryExecution().optimizedPlan().toString()
