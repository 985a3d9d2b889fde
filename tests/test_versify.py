import pytest
from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.functions import refs
from versewright.operators import versify
from versewright.operators.skew import attach, islands


def rng(a, b):
    return refs.ref_range(refs.ref(*map(F.lit, a)), refs.ref(*map(F.lit, b)))


def test_packaged_versifications(chapters):
    totals = {r.vers_name: (r.n, r.v) for r in chapters.groupBy("vers_name").agg(
        F.count("*").alias("n"), F.sum("last_verse").alias("v")).collect()}
    assert totals == {"esv": (1189, 31103), "kjv": (1189, 31102)}
    esv, kjv = (chapters.where(f"vers_name = '{v}'") for v in ("esv", "kjv"))
    assert {tuple(r) for r in versify.differences(esv, kjv).collect()} == {(64, 1, 15, "left"), (64, 1, 14, "right")}


def test_next_and_previous_undo_each_other(spark, chapters):
    esv = chapters.where("vers_name = 'esv'")
    every = dims.verse_index(esv).select("vers_name", "verse_ord", "book_ord", "chapter", "verse")
    d = versify.neighbours(every.drop("verse_ord"), esv)
    assert d.where("next is null").select("book_ord", "chapter", "verse").collect() == [(66, 22, 21)]
    back = d.where("next is not null").select("vers_name", refs.ref("book_ord", "chapter", "verse").alias("r"), "next.*")
    back = versify.neighbours(back, esv)
    assert back.where("prev <> r").count() == 0


@pytest.mark.parametrize("a, b, size, parts", [
    ((1, 1, 1), (1, 1, 31), 31, 1), ((1, 1, 31), (1, 2, 1), 2, 2), ((43, 20, 30), (44, 2, 3), 56, 4),
    ((66, 22, 21), (1, 1, 1), 31103, 1189), ((1, 1, 32), (1, 2, 1), None, 0),
])
def test_size_and_split(spark, chapters, a, b, size, parts):
    d = spark.range(1).select(F.lit("esv").alias("vers_name"), rng(a, b).alias("range"))
    assert versify.range_size(d, chapters).first()["size"] == size
    split = versify.split_by_chapter(d, chapters)
    assert split.count() == parts
    if size:
        assert versify.range_size(split, chapters, "part").agg(F.sum("size")).first()[0] == size


def test_clamp_and_validity(spark, chapters):
    d = spark.createDataFrame(
        [("esv", 1, 1, 99), ("esv", 99, 0, 5), ("kjv", 64, 1, 15), ("esv", 64, 1, 15)],
        "vers_name string, book_ord int, chapter int, verse int",
    )
    assert {tuple(r) for r in versify.clamp(d, chapters).collect()} == {
        ("esv", 1, 1, 31), ("esv", 66, 1, 5), ("kjv", 64, 1, 14), ("esv", 64, 1, 15)}
    assert versify.valid_only(d, chapters).count() == 1


def test_derived_versification_takes_the_closest_default(spark, chapters):
    rows = [(s, 64, 1, v) for s, last in (("e", 15), ("k", 14)) for v in range(1, last + 1)] + [("x", 1, 1, 2)]
    verses = spark.createDataFrame(rows, "scripture string, book_ord int, chapter int, verse int")
    derived = versify.derive(verses, dims.books(spark), chapters)
    same = {r.vers_name: r.same_as for r in versify.intern(derived, chapters).collect()}
    assert same == {"e": "esv", "k": "kjv", "x": "x"}
    assert all(r.complete for r in versify.complete(derived).collect())


def test_spellings_keep_books_apart(spark):
    spelled = dims.name_aliases(dims.book_names(spark)).groupBy("lang").count().collect()
    names = {lang: len(fixed.names_of(lang)) for lang in ("en", "de")}
    assert {r.lang: r["count"] + names[r.lang] for r in spelled} == {"en": 1525, "de": 582}


def test_attach_equals_a_join_with_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"))
    right = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).select(*left.columns).collect()))
        for bounded in (False, True):
            got = attach(left, right, ["k"], how, bounded)
            assert sorted(map(tuple, got.select(*left.columns).collect())) == want


def test_only_bounded_sides_are_broadcast(spark):
    left = spark.range(1000).select("id", (F.col("id") % 5).alias("k"))
    long = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("v"))
    lists = left.groupBy("k").agg(F.collect_list("id").alias("ids"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for right in (long, lists):
        assert "Broadcast" not in plan(attach(left, right, ["k"]))
        assert "Broadcast" in plan(attach(left, right, ["k"], "inner", True))


def test_islands_cross_buckets(spark):
    rows = [("hot", i, i // 7 % 2) for i in range(500)] + [("b", i, i % 3 // 2) for i in range(0, 200, 5)]
    d = spark.createDataFrame(rows, "key string, pos long, v long")
    changes = lambda a, b: a != b
    got = {(r.key, r.pos): r.run for r in islands(d, ["key"], "pos", 16, {"run": (F.col("v"), changes)}).collect()}
    want, last, run = {}, None, 0
    for key, pos, v in sorted(rows):
        run = 1 if last is None or last[0] != key else run + (last[1] != v)
        want[key, pos], last = run, (key, v)
    assert got == want


def test_a_derived_versification_reads_the_verses_once(spark, chapters):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    verses = spark.createDataFrame([("s", 1, 1, 31), ("s", 1, 1, 30), ("t", 40, 1, 25)], "scripture string, book_ord int, chapter int, verse int")
    verses = verses.mapInPandas(counted, verses.schema)
    assert versify.derive(verses, dims.books(spark), chapters).count() > 0
    assert read.value == 3
