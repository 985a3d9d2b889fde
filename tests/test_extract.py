import random
import re
import time

import pytest
from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.functions import mask as masks
from versewright.functions import refs
from versewright.functions import text as tx
from versewright.operators import extract, versify

LASTS = fixed.last_verses("esv")
#: A letter stays between these names and a number, as their shorter spelling is tried first.
QUIRKS = {"Ezra", "Esra"}


def written(rnd, lang):
    """A name, a passage of some form and the ranges it means, by the rules and not by the code."""
    book, name = rnd.choice([n for n in fixed.names_of(lang) if n[1] not in QUIRKS and len(LASTS[n[0] - 1]) > 1])
    lasts = LASTS[book - 1]
    c = rnd.randint(1, len(lasts) - 1)
    d = rnd.randint(c + 1, min(c + 2, len(lasts)))
    v = rnd.randint(1, lasts[c - 1] - 1)
    w = rnd.randint(v + 1, lasts[c - 1])
    y = rnd.randint(1, lasts[d - 1])
    return name, book, rnd.choice([
        (f"{c},{v}", [(c, v, c, v)]), (f"{c}:{v}", [(c, v, c, v)]), (f"{c}, {v}-{w}", [(c, v, c, w)]),
        (f"{c},{v}.{w}", [(c, v, c, v), (c, w, c, w)]), (f"{c}", [(c, 1, c, lasts[c - 1])]),
        (f"{c}-{d}", [(c, 1, d, lasts[d - 1])]), (f"{c},{v}-{d},{y}", [(c, v, d, y)]), (f"{c}-{d},{y}", [(c, 1, d, y)]),
        (f"{c},{v}f.", [(c, v, c, v)]), (f"{c},{v};{d},{y}", [(c, v, c, v), (d, y, d, y)]),
    ])


def plain(ranges):
    return [(x["from"].book_ord, x["from"].chapter, x["from"].verse, x["to"].chapter, x["to"].verse) for x in ranges]


@pytest.mark.parametrize("lang, joint", [("de", " sowie "), ("en", " with ")])
def test_several_citations_in_a_text(spark, chapters, lang, joint):
    rnd, rows, wanted = random.Random(8), [], {}
    for i in range(150):
        parts = [written(rnd, lang) for _ in range(rnd.randint(1, 6))]
        text, at = "", []
        for name, book, (passage, ranges) in parts:
            text += joint
            at.append((len(text), [(book, *r) for r in ranges]))
            text += f"{name} {passage}"
        rows.append((i, text))
        wanted[i] = at
    found = {}
    d = spark.createDataFrame(rows, "id int, text string")
    for r in extract.find_citations(d, chapters, "text", lang).collect():
        found.setdefault(r.id, []).append((r.begin, plain(r.ranges)))
    assert {i: sorted(x) for i, x in found.items()} == wanted


def test_position_picks_the_citation_it_lies_in(spark, chapters):
    rnd, rows, wanted = random.Random(5), [], {}
    for i in range(120):
        (a, book_a, (pa, ra)), (b, book_b, (pb, rb)) = written(rnd, "de"), written(rnd, "de")
        text = f"Hier: {a} {pa} Hallo {b} {pb} Schluss"
        second = text.index(f" Hallo {b}") + 7
        spots = {"name": (rnd.randint(6, 6 + len(a)), book_a, ra), "between": (text.index(" Hallo") + 3, None, []),
                 "second": (second + len(b) + 1, book_b, rb), "end": (len(text) - 1, None, []), "before": (2, None, [])}
        for spot, (index, book, ranges) in spots.items():
            rows.append((f"{i} {spot}", text, index))
            wanted[f"{i} {spot}"] = [(book, *r) for r in ranges]
    d = spark.createDataFrame(rows, "id string, text string, idx int")
    assert {r.id: plain(r.ranges) for r in extract.parse_at(d, chapters).collect()} == wanted


@pytest.mark.parametrize("text", [
    "Hiob 43,1", "Judas 2,1", "Ps 117,3", "Amos 0,4", "Amos 4,0", "Hosea 4294967296,1", "Offenbarung ohne Zahl", "", "4711",
])
def test_what_does_not_exist_is_not_found(spark, chapters, text):
    d = spark.createDataFrame([(text,)], "text string")
    assert extract.find_citations(d, chapters).count() == 0


def test_names_as_ocr_reads_them(spark, chapters):
    rows = [("lKön 8,27", 11, 8, 27), ("2.Sa-\nmuel 7,12", 10, 7, 12), ("Off en barung 21,4", 66, 21, 4), ("IIChronik", 0, 0, 0)]
    for text, book, chapter, verse in rows:
        got = [r for r in extract.find_citations(spark.createDataFrame([(text,)], "text string"), chapters).collect()]
        assert [x[:3] for r in got for x in plain(r.ranges)] == ([(book, chapter, verse)] if book else []), text


@pytest.mark.parametrize("filler", ["Ж", "—", " ", "\n", "7 ", "7"])
def test_long_runs_behind_a_name_end(spark, chapters, filler):
    text = f"Amos {filler * 1_000_000} Amos 3,7"
    d = spark.createDataFrame([(text,)], "text string")
    start = time.time()
    found = extract.find_citations(d, chapters).collect()
    assert (30, 3, 7, 3, 7) in [x for r in found for x in plain(r.ranges)]
    at = extract.parse_at(d.withColumn("idx", F.lit(len(text) - 2)), chapters).first()
    assert plain(at.ranges) == [(30, 3, 7, 3, 7)]
    assert time.time() - start < 60


def test_many_citations_in_one_text(spark, chapters):
    n = 100_000
    d = spark.range(1).select(F.repeat(F.lit("Amos 3,7 dort "), n).alias("text"))
    start = time.time()
    found = extract.find_citations(d, chapters)
    assert found.agg(F.count("*"), F.max("begin")).first() == (n, 14 * (n - 1))
    assert time.time() - start < 60


def test_chapters_that_a_versification_lacks(spark):
    rows = [("x", 1, 1, 10, 1, 0), ("x", 1, 3, 5, 2, 10)]
    own = spark.createDataFrame(rows, "vers_name string, book_ord int, chapter int, last_verse int, chapter_idx int, start_ord int")
    asked = spark.createDataFrame([("x", 1, c, v) for c, v in ((1, 10), (2, 1), (3, 5), (3, 6), (9, 9))], "vers_name string, book_ord int, chapter int, verse int")
    assert sorted((r.chapter, r.verse) for r in versify.valid_only(asked, own).collect()) == [(1, 10), (3, 5)]
    clamped = {(r.chapter, r.verse) for r in versify.clamp(asked, own).collect()}
    assert clamped == {(1, 10), (1, 1), (3, 5)}
    text = spark.createDataFrame([("1.Mose 3,5 und 1.Mose 2,1",)], "text string")
    found = extract.find_citations(text, own, "text", "de", "x").collect()
    assert [plain(r.ranges) for r in found] == [[(1, 3, 5, 3, 5)]]
    assert dims.book_chapters(own).first().chapter_count == 3 == versify.chapter_counts(own).first().chapter_count


def test_offsets_survive_reserved_characters(spark, chapters):
    d = spark.createDataFrame([("﷐ä﷑ Amos 3,7 und 𝒳 Hiob 1,1",)], "text string")
    got = sorted((r.begin, r.end) for r in extract.find_citations(d, chapters).collect())
    assert got == [(4, 12), (19, 27)]


def test_running_sums(spark):
    rnd = random.Random(1)
    rows = [([rnd.randint(0, 9) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 1500)]
    for r in spark.createDataFrame(rows, "v array<int>").select("v", extract.running(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]


@pytest.mark.parametrize("markup, want", [
    ("<p>" + "<b><i>" * 3 + "deep" + "</i></b>" * 3 + "</p>", "deep"), ("<p>up<br/>on<!-- <b> --></p>", "upon"),
    ("<p>&#0000000065;&#x00042;</p>", "AB"), ("<p>one</p><p> </p><p>two</p>", "one two"),
    ("<p><b>cross</p></b>", "<p><b>cross</p></b>"), ("<p>open", "<p>open"), ("less < more", "less < more"), ("bare", "bare"),
])
def test_markup_to_plain(spark, markup, want):
    assert spark.createDataFrame([(markup,)], "m string").select(tx.markup_to_plain(F.col("m")).alias("t")).first().t == want


def filled(mask, values):
    """Masks read from the inside out: the innermost group without braces is decided first, then it is plain text."""
    named = re.compile("|".join(re.escape(f"[{k}]") for k in values))
    while group := re.search(r"\{([^{}]*)\}", mask):
        inner = group[1]
        known = [values[k[1:-1]] for k in named.findall(inner)]
        shown = named.sub(lambda k: values[k[0][1:-1]], inner)
        result = shown if any(known) else "" if known else f"\0{inner}\1"
        mask = mask[:group.start()] + result + mask[group.end():]
    return named.sub(lambda k: values[k[0][1:-1]], mask).replace("\0", "{").replace("\1", "}")


def test_masks_by_brute_force(spark):
    rnd = random.Random(2)
    texts = {"book": "Amos", "copyright": "", "scripture": "Eigene"}
    rng = refs.ref_range(refs.ref(*map(F.lit, (30, 3, 7))), refs.ref(*map(F.lit, (30, 3, 7))))
    pieces = ["[book]", "[copyright]", "[scripture]", "vgl. ", " / "]
    values = masks.values_of(rng, {k: F.lit(v) for k, v in texts.items()})
    wanted, columns = [], []
    for _ in range(40):
        group = "{" + "".join(rnd.choices(pieces, k=2)) + "}"
        mask = "".join(rnd.choices([*pieces, group], k=4))
        wanted.append(filled(mask, texts))
        columns.append(masks.render(mask, values).alias(f"m{len(columns)}"))
    assert list(spark.range(1).select(*columns).first()) == wanted


def test_recurring_texts_are_read_once(spark, chapters):
    """Equal texts of equal language and versification are read once, with the rows that reading each gives."""
    texts = ["Joh 3,16", "Joh 3,16", "Mk 1,2.4-5 und Lk 2", "nichts", "", None, "Jn 3:16", "Joh 99,1"]
    rows = [(i, t, lang, vers) for i, (t, lang, vers) in enumerate((t, lang, v) for t in texts for lang in ("de", "en", None) for v in ("esv", "kjv", None))]
    d = spark.createDataFrame(rows, "id int, text string, l string, v string")
    for lang, vers in ((F.col("l"), F.col("v")), ("de", "esv")):
        for unread in (False, True):
            a = extract.find_citations(d, chapters, "text", lang, vers, unread)
            b = extract.find_citations(d, chapters, "text", lang, vers, unread, recurring=True)
            assert sorted(a.columns) == sorted(b.columns)
            assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
            assert a.count() > 0
    many = spark.range(5000).select("id", F.lit("Joh 3,16").alias("text"))
    plan = extract.find_citations(many, chapters, "text", "de", "esv", recurring=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("inline_outer" if "inline_outer" in plan else "inline")  # the texts are distinct below the reading


def test_normalized_texts_by_the_patterns(spark):
    """Every character, alone and between others, as the two patterns give it; ASCII needs no pattern."""
    chars = [chr(c) for c in (*range(1, 0x300), *range(0x1680, 0x1690), *range(0x180A, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFE58, 0xFE63, 0xFEFF, 0xFF0D, 0x1F600)]
    d = spark.createDataFrame([(t,) for c in chars for t in (c, f"a{c}{c} .*1\n")] + [("",), (None,), ("".join(chars),)], "t string")
    for lang in ("de", "en"):
        by_patterns = F.regexp_replace(F.regexp_replace("t", f"[{tx.DROPPED}]+", ""), f"[^{fixed.LETTERS[lang]}0-9]", "*")
        assert d.where(~tx.normalized(F.col("t"), lang).eqNullSafe(by_patterns)).count() == 0
    plan = d.select(tx.normalized(F.col("t"), "en").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "translate(" in plan


@pytest.mark.parametrize("lang", ["de", "en"])
def test_patterns_stay_short(lang):
    # Spark compares the pattern with the one before for every row: these had 700,000 characters.
    assert len(tx.citation_pattern(lang)) < 40_000
    assert len(tx.numbered_name(lang)) < 5_000


@pytest.mark.parametrize("number, read", [
    ("4294967295", "4294967295"), ("4294967296", None), ("4294967300", None), ("5000000000", None), ("12345678901", None),
    ("0004294967295", "0004294967295"), ("00042949672950", None), ("999999999", "999999999"), ("34", "34"),
])
def test_numbers_up_to_the_limit(number, read):
    pattern = re.compile(tx.number_pattern("en"))
    found = pattern.match(number)
    assert (found and found.group()) == read


def test_a_digit_of_the_next_name_is_no_number():
    assert re.match(tx.number_pattern("en"), "31 Samuel 2").group() == "3"
    # The last digit begins a name, so what is left is small enough.
    assert re.match(tx.number_pattern("en"), "42949672941 Samuel").group() == "4294967294"


def test_single_verses_are_read_as_by_the_fold(spark, chapters, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 66), rnd.choice(["", " ", "  "]) + str(rnd.choice([rnd.randint(1, 4), rnd.randint(0, 152)])) + rnd.choice([",", ":", " . ", ";", "+ ", "&"])
             + str(rnd.choice([*[rnd.randint(1, 20)] * 4, 0, rnd.randint(1, 180), 2 ** 40, 10 ** 25])) + rnd.choice(["", "", " "])) for i in range(2000)]
    d = spark.createDataFrame(rows, "i int, book_ord int, passage string").withColumn("vers_name", F.lit("esv"))

    def read():
        found = extract.with_ranges(d, chapters, keep_unread=True)
        return {r.i: plain(r.ranges) for r in found.select("i", "ranges").collect()}

    short = read()
    monkeypatch.setattr(extract, "SINGLE", "^never$")
    assert short == read()
    assert sum(map(bool, short.values())) > 50
