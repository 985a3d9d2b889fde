import os
import random
import re
import tempfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from versewright import registry
from versewright.sources import archives, captures, markup, metadata, snapshots
from versewright.streaming import signals

USFM = r"""\id JON Probe
\h Jona
\toc1 Das Buch Jona
\toc3 Jon
\mt Jona
\c 1
\esb
\p Am Rand
\esbe
\q1
\v 1-2 Wind\x + \xt Am 3.7\x* und \qt Wellen\qt*
\q2 hoch
\b
\m
\v 3 Schiff \fig Bild|src="s.png"\fig*und \k Mast\k*
\tr \tc1 Fracht \tc2 Gold
\c 2
\p
\v 1 \w Fisch|strong="H1"\w*\f - \ft Anmerkung\f* <gross>
\v 3
\v 3 noch
"""
USX = (
    '<usx version="3.0"><book code="JON" style="id">Probe</book><para style="h">Jona</para><para style="toc1">Das Buch Jona</para>'
    '<para style="toc3">Jon</para><para style="mt">Jona</para><chapter number="1" style="c"/><sidebar style="esb"><para style="p">Am Rand</para></sidebar>'
    '<para style="q1"><verse number="1-2" style="v"/>Wind<note caller="+" style="x"><char style="xt">Am 3.7</char></note> und <char style="qt">Wellen</char></para>'
    '<para style="q2">hoch</para><para style="b"/><para style="m"><verse number="3" style="v"/>Schiff <figure style="fig" file="s.png">Bild</figure>und '
    '<char style="k">Mast</char></para><table><row style="tr"><cell style="tc1">Fracht</cell><cell style="tc2">Gold</cell></row></table>'
    '<chapter number="2" style="c"/><para style="p"><verse number="1" style="v"/><char style="w" strong="H1">Fisch</char>'
    '<note caller="-" style="f"><char style="ft">Anmerkung</char></note> &lt;gross&gt; <verse number="3" style="v"/><verse number="3" style="v"/>noch</para></usx>'
)
VERSES = {
    (1, 1): '<p data-id="begin">Wind und Wellen</p><p data-id="begin">hoch</p>', (1, 2): "",
    (1, 3): '<p data-id="begin">Schiff und Mast</p><p data-id="undefined">FrachtGold</p>',
    (2, 1): '<p data-id="begin">Fisch &lt;gross&gt; </p>', (2, 3): '<p data-id="continue">noch</p>',
}


@pytest.mark.parametrize("fmt, text", [("usfm", USFM), ("usx", USX)])
def test_both_formats_give_the_same_book(spark, fmt, text):
    d = spark.createDataFrame([("a.zip", 0, "x", text, fmt)], "file string, entry_idx int, entry string, text string, format string")
    docs = markup.book_names(markup.documents(d))
    doc = docs.first()
    assert (doc.error, doc.book_ord, doc.short_name, doc.abbreviation, doc.long_name) == (None, 32, "Jona", "Jon", "Das Buch Jona")
    rows = markup.verse_rows(docs).collect()
    assert {(r.chapter, r.verse): r.markup for r in rows} == VERSES
    assert {(r.chapter, r.verse): r.cross_references for r in rows if r.cross_references} == {(1, 1): ["Am 3.7"]}


def _zip(folder, name, entries):
    with zipfile.ZipFile(os.path.join(folder, f".{name}.part"), "w") as archive:
        for entry, content in entries.items():
            archive.writestr(entry, content)
    os.replace(os.path.join(folder, f".{name}.part"), os.path.join(folder, name))


def test_incremental_load_of_a_folder(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    source, store, target = (os.path.join(folder, n) for n in ("src", "store", "target"))
    os.mkdir(source), os.mkdir(target)
    settings = "<ScriptureText><FullName>Probe</FullName>{}</ScriptureText>"
    chapter = "\\id OBA\n\\c 1\n\\m\n" + "".join(f"\\v {i} Wort\n" for i in range(1, 22))
    _zip(source, "k.zip", {"in/JON.usfm": USFM, "more/JON.SFM": "\\id JON\n\\c 1\n\\p\n\\v 1 zu tief\n", "metadata.xml": "<open>", "readme.txt": "x" * 99,
                           "Settings.xml": settings.format("<Name>Pr</Name>")})
    _zip(source, "l.zip", {"OBA.sfm": chapter, "settings.xml": settings.format("")})
    _zip(source, "alien.zip", {"ZZZ.usfm": "\\id ZZZ\n\\c 1\n\\p\n\\v 1 x\n"})
    _zip(source, "latin.zip", {"AMO.usfm": b"\\id AMO\n\\c 1\n\\p\n\\v 1 \xe4\n"})
    _zip(source, "other.zip", {"notes.txt": "nothing"})
    _zip(source, "void.zip", {})
    with open(os.path.join(source, "text.zip"), "w") as f:
        f.write("no archive at all")
    _zip(source, "hole.zip", {"HOS.usfm": "\\id HOS\n\\c 1\n\\p\n\\v 1 " + "wort " * 50})
    with open(os.path.join(source, "hole.zip"), "r+b") as f:  # its data no longer fits its check sum
        data = f.read()
        f.seek(data.index(b"wort wort"))
        f.write(b"WORT")
    _zip(source, "lock.zip", {"JOL.usfm": "\\id JOL"})
    with open(os.path.join(source, "lock.zip"), "r+b") as f:  # the flag of encryption in both headers
        data = bytearray(f.read())
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            data[data.index(mark) + at] |= 1
        f.seek(0)
        f.write(data)
    errors = {
        "k.zip": None, "l.zip": None, "alien.zip": "no book of the app", "latin.zip": "AMO.usfm: no UTF-8 text", "other.zip": "no reader",
        "void.zip": "empty archive", "text.zip": "no zip archive", "hole.zip": "HOS.usfm: damaged", "lock.zip": "JOL.usfm: encrypted",
    }
    assert {r.file: r.error for r in archives.load(spark, f"file:{source}", store).collect()} == errors
    verses = archives.store_table(spark, store, "verses")
    assert verses.groupBy("scripture").count().orderBy("scripture").collect() == [("k.zip", 5), ("l.zip", 21)]
    assert archives.passage(verses, "k.zip", 32, 1, 3).first().markup == VERSES[1, 3]
    catalog = {r.file: (r.catalog_name, r.abbreviation) for r in archives.catalog(archives.store_table(spark, store, "info")).collect()}
    assert catalog == {"k.zip": ("Probe", "Pr"), "l.zip": ("Probe (1)", "Unknown Abbreviation")}
    # One vanishes, one no longer reads: neither is in the catalog, only what no longer reads keeps its verses.
    _zip(source, "m.zip", {"OBA.sfm": chapter})
    archives.load(spark, f"file:{source}", store)
    os.remove(os.path.join(source, "l.zip"))
    _zip(source, "k.zip", {"JON.usfm": b"\\id JON\n\\c 1\n\\p\n\\v 1 \xff\n"})
    status = {r.file: r.error for r in archives.load(spark, f"file:{source}", store).collect()}
    assert status == {k: v for k, v in errors.items() if k != "l.zip"} | {"k.zip": "JON.usfm: no UTF-8 text"}
    assert {r.scripture for r in archives.store_table(spark, store, "verses").select("scripture").distinct().collect()} == {"k.zip", "m.zip"}
    for table in ("info", "names"):
        assert {r.file for r in archives.store_table(spark, store, table).select("file").distinct().collect()} == {"m.zip"}
    assert {(r.file, r.stamp is None) for r in snapshots.manifest(spark, store).collect()} == {("k.zip", True), ("m.zip", False)}
    assert archives.import_archives(spark, f"file:{source}", target) == 1
    assert [n for n in os.listdir(target) if not n.startswith(".")] == ["m.zip"]
    assert archives.import_archives(spark, f"file:{target}", f"{target}/") == 0


CHAPTER = "\\id OBA\n\\c 1\n\\m\n" + "".join(f"\\v {i} Wort\n" for i in range(1, 22))


def _state(spark, store):
    return {t: sorted(map(str, archives.store_table(spark, store, t).collect())) for t in ("verses", "names", "info")}


def test_a_load_that_stops_leaves_the_version_before(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    source, store = os.path.join(folder, "src"), os.path.join(folder, "store")
    os.mkdir(source)
    _zip(source, "a.zip", {"OBA.sfm": CHAPTER})
    archives.load(spark, f"file:{source}", store)
    before, version = _state(spark, store), snapshots.current(spark, store)
    assert version == 1 and len(before["verses"]) == 21
    archives.load(spark, f"file:{source}", store)
    assert snapshots.current(spark, store) == 1  # nothing has changed
    _zip(source, "b.zip", {"OBA.sfm": CHAPTER})
    os.remove(os.path.join(source, "a.zip"))

    def breaks(entries):
        out = archives.read_archives(entries)
        return out | {"info": out["info"].where(F.raise_error(F.lit("stopped")).isNotNull())}  # after verses and names are written

    with pytest.raises(Exception, match="stopped"):
        archives.load(spark, f"file:{source}", store, reader=breaks)
    assert snapshots.current(spark, store) == 1 and _state(spark, store) == before
    archives.load(spark, f"file:{source}", store)
    assert {r.scripture for r in archives.store_table(spark, store, "verses").select("scripture").distinct().collect()} == {"b.zip"}
    # Two loads from one version: the second is refused, and what it has written is in no version.
    rows = {t: archives.store_table(spark, store, t).withColumnsRenamed({"scripture": "file"}) for t in ("verses", "names", "info")}
    kept = snapshots.manifest(spark, store)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, store, 1, rows, lambda load: kept)
    after = _state(spark, store)
    assert len(snapshots.expire(spark, store)) == 3 and _state(spark, store) == after
    assert snapshots.read(spark, store, "verses", 2).count() == 21


def test_a_watched_folder(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    source, store = os.path.join(folder, "src"), os.path.join(folder, "store")
    os.mkdir(source)
    seen = []

    def reader(entries):
        seen.append({r.file for r in entries.select("file").distinct().collect()})
        return archives.read_archives(entries)

    def until(version, files):
        deadline = time.time() + 120
        while snapshots.current(spark, store) < version and time.time() < deadline:
            assert q.isActive, q.exception()
            time.sleep(0.5)
        assert {r.scripture for r in archives.store_table(spark, store, "verses").select("scripture").distinct().collect()} == files

    _zip(source, "a.zip", {"OBA.sfm": CHAPTER})
    _zip(source, "b.zip", {"OBA.sfm": CHAPTER})
    q = signals.watch_folder(spark, f"file:{source}", store, f"{folder}/state", "1 second", reader).start()
    try:
        until(1, {"a.zip", "b.zip"})
        os.remove(os.path.join(source, "a.zip"))
        until(2, {"b.zip"})
        _zip(source, "b.zip", {"OBA.sfm": CHAPTER + "\\c 2\n\\m\n\\v 1 mehr\n"})
        until(3, {"b.zip"})
        assert archives.store_table(spark, store, "verses").count() == 22
        _zip(source, "c.zip", {"OBA.sfm": CHAPTER})
        until(4, {"b.zip", "c.zip"})
    finally:
        q.stop()
    assert [s for s in seen if s] == [{"a.zip", "b.zip"}, {"b.zip"}, {"c.zip"}]


def test_catalog_names_by_brute_force(spark):
    rnd = random.Random(12)
    names = [rnd.choice(["Alt", "Alt", "Neu", "Alt (2)", "Neu (1)", "Alt (1) (1)", "Neu (03)", "Alt (4000000000)"]) for _ in range(30)]
    taken = []
    for name in names:
        if name in taken:
            numbers = [int(m[1]) for t in taken if (m := re.fullmatch(re.escape(name) + r" \((0|[1-9][0-9]*)\)", t))]
            name = f"{name} ({max(numbers, default=0) + 1})"
        taken.append(name)
    d = spark.createDataFrame([(f"f{i:02}", n) for i, n in enumerate(names)], "file string, name string")
    assert [r.catalog_name for r in archives.named(d).orderBy("file").collect()] == taken


def _record(rnd):
    """What a scripture's files may tell; None where they don't."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))).title()
    maybe = lambda value: value if rnd.random() < 0.8 else None
    return {"name": maybe(f"{word()} & {word()}"), "abbreviation": maybe(word().lower() + str(rnd.randint(0, 99))), "language": maybe(word()),
            "copyright": maybe(f"{word()} < {word()} {rnd.randint(1800, 2030)}")}


def _xml(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _page(rnd, r):
    """A web page of the record: parts in tags of either case, remarks and markup around them."""
    q, up = rnd.choice("\"'"), rnd.choice([str, str.upper])
    parts = ["<html><head><title>none of it</title></head>"]
    if r["abbreviation"]:
        parts.append(f"<nav class={q}toc{q}>\n <a rel=x href={q}http://host/a/{r['abbreviation']}{q}>read</a></nav>")
    if r["name"]:
        parts.append(f"<{up('h1')}{rnd.choice(['', ' id=t'])}> {_xml(r['name'])}</{up('h1')}>")
    if r["copyright"]:
        parts.append(f"<{up('p')}>{_xml(r['copyright']).replace(' ', rnd.choice([' ', '<i> </i>']), 1)}<{up('br')}>second line</{up('p')}>")
    if r["language"]:
        parts.append(f"<div>Language:{rnd.choice(['', ' '])}<a href={q}x{q}>{r['language']}{rnd.choice(['', ' (own name)'])}</a></div>")
    return "".join(parts)


def _bundle(rnd, r):
    """Bundle metadata of the record: local values beside other ones, that count less, or alone."""
    def both(name, value):
        local = value is not None and rnd.random() < 0.5
        if value is None:
            return ""
        return f"<{name}>{'other' if local else _xml(value)}</{name}>" + (f"<{name}Local>{_xml(value)}</{name}Local>" if local else "")

    statement = f"<copyright><full><statementContent><p>{_xml(r['copyright'])}</p></statementContent></full></copyright>" if r["copyright"] else ""
    language = f"<language>{both('name', r['language'])}</language>" if r["language"] else ""
    return (f"<Meta><identification>{both('name', r['name'])}{both('abbreviation', r['abbreviation'])}</identification>{language}{statement}</Meta>")


def _settings(rnd, r):
    names = {"FullName": "name", "Name": "abbreviation", "Language": "language", "Copyright": "copyright"}
    parts = [f"<{tag}>{_xml(r[key])}</{tag}>" for tag, key in names.items() if r[key]]
    rnd.shuffle(parts)
    return "<S>" + "<Deep><Name>no child of the root</Name></Deep>" * rnd.randint(0, 1) + "".join(parts) + "</S>"


@pytest.mark.parametrize("reader, render", [("ebible", _page), ("dbl", _bundle), ("paratext", _settings)])
def test_metadata_of_generated_files(spark, reader, render):
    rnd = random.Random(reader)
    records = [_record(rnd) for _ in range(25)]
    for r in records if reader == "dbl" else []:  # without a name of its own, a bundle takes any other name in it
        r["name"] = r["name"] or "Somewhat"
    rows = [(i, render(rnd, r)) for i, r in enumerate(records)] + [(99, "<a><b>")]
    found = spark.createDataFrame(rows, "i int, t string").select("i", metadata.READERS[reader](F.col("t")).alias("r"))
    got = {x.i: x.r and x.r.asDict() for x in found.collect()}
    if reader != "ebible":  # a page needs no form, the others are XML
        assert got[99] is None
    assert [got[i] for i in range(25)] == records


def test_broken_captures_are_rejected(spark):
    good = "image 10 20\r\ntext 0 0 9 9 a\\nb \\\\n\nword 1 2 3 4 0 - w x\nword 5 2 3 4 - - \nlayout 0 0 9 9 - - - -\n"
    files = spark.createDataFrame(
        [("ok", good), ("cut", good + "word 1 2 3"), ("none", "text 0 0 1 1 a"), ("zero", "image 0 5")], "image_id string, content string")
    parsed = captures.parsed(files)
    words = captures.words(parsed).orderBy("word_idx").collect()
    assert [(r.image_id, r.text, r.line and r.line.text) for r in words] == [("ok", "w x", "a\nb \\n"), ("ok", "", None)]
    assert [r.para_box for r in captures.layouts(parsed).collect()] == [None]


def test_providers(spark):
    reg = registry.default_registry()
    tables = {"scriptures": spark.createDataFrame([("A", "a", "de", None)], registry.SCHEMAS["scriptures"])}
    reg.add_scriptures("web", tables)
    assert reg.table("scriptures").first().scripture == "A (web)"
    with pytest.raises(ValueError):
        registry.conform(spark.createDataFrame([("A",)], "scripture string"), "scriptures")
    url = reg.lookups["bible_com"].url(F.array(F.lit("XXX"), F.lit("King James Version")), F.lit(19), F.lit(23), F.lit(1), F.lit(3))
    assert spark.range(1).select(url.alias("u")).first().u == "https://www.bible.com/bible/1/PSA.23.1-3.KJV"
    registry.register_functions(spark, {"twice": F.udf(lambda x: x * 2, "long")})
    assert spark.sql("SELECT twice(4) AS t").first().t == 8


def test_texts_of_captures_are_numbered_without_a_join(spark):
    box = "struct<x:int,y:int,w:int,h:int>"
    one, two = ("one", (0, 0, 9, 9)), ("two", (0, 30, 9, 9))
    rows = [("a", 0, "w", (0, 0, 1, 1), None, None), ("a", 1, "v", (1, 0, 1, 1), one, two), ("a", 2, "v", (2, 0, 1, 1), two, one),
            ("a", 2, "u", (3, 0, 1, 1), two, None), ("b", 0, "w", (0, 0, 1, 1), two, None), ("b", 1, "w", (0, 0, 1, 1), None, two)]
    words = spark.createDataFrame(rows, f"image_id string, word_idx int, text string, box {box}, line struct<text:string,box:{box}>, para struct<text:string,box:{box}>")
    found = captures._numbered(words)
    got = {(r.image_id, r.word_idx, r.text, r.box.x, r.line_n, r.para_n) for r in found.collect()}
    assert got == {("a", 0, "w", 0, None, None), ("a", 1, "v", 1, 0, 1), ("a", 2, "v", 2, 1, 0), ("a", 2, "u", 3, 1, None),
                   ("b", 0, "w", 0, 0, None), ("b", 1, "w", 0, None, 0)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
