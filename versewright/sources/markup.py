"""USFM and USX documents to verses, as one DataFrame job.

Both formats are rewritten, by patterns over the whole text, into one flat notation of tags (chapter, verse, paragraph,
row, note, inline style) between two noncharacters.  Documents are then exploded into chapters, blocks and verse units,
windows per chapter carry verse and paragraph state, and two aggregations assemble the verses.  Work is keyed by
document *and* chapter, so one large document spreads over its chapters.

Input: ``file, entry_idx, entry, text, format`` (``usfm`` or ``usx``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..operators.extract import computed_once

A, Z = "\uFDD0", "\uFDD1"
# Stand-ins for escaped characters of USFM until the markers are read.
ESCAPES = [("\\\\", "\uFDD2", "\\"), ("\\~", "\uFDD3", "~"), ("\\/", "\uFDD4", "/"), ("\\|", "\uFDD5", "|")]
RESERVED = A + Z + "".join(mark for _, mark, _ in ESCAPES)

KEYS = ["file", "entry_idx", "book_ord"]
BLOCK = f"{A}(?:p:|/p{Z}|b:|r{Z}|t{Z})"
END = "(?![A-Za-z*])"


def tag(name: str) -> str:
    return A + name + Z


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def cleaned(text: Column) -> Column:
    """Without byte order mark and without the noncharacters the notation uses."""
    plain = F.regexp_replace(text, "^\uFEFF", "")
    return F.when(plain.rlike(f"[{RESERVED}]"), F.translate(plain, RESERVED, "\uFFFD" * len(RESERVED))).otherwise(plain)


def flat_usfm(text: Column) -> Column:
    """A USFM text in the flat notation, its text escaped for markup."""
    t = F.regexp_replace(cleaned(text), "\r\n?", "\n")
    for written, mark, _ in ESCAPES:
        t = F.replace(t, F.lit(written), F.lit(mark))
    t = F.replace(t, F.lit("~"), F.lit("\u00A0"))
    paragraphs = "|".join(fixed.PARAGRAPH_MARKERS)
    stops = f"(?:(?:{paragraphs}|{'|'.join(fixed.CELL_MARKERS)}|tr)(?![A-Za-z])\\d*+{END}|" \
            f"\\+?(?:v|c|id|usfm|esb|esbe|periph)\\d*+{END})"
    note = lambda names: (
        f"\\\\({names})\\d*+(?![A-Za-z*+-])\\s*+[^\\s{A}]*+\\s?"
        f"([^\\\\]*+(?:\\\\(?!{stops}|\\1\\*)[^\\\\]*+)*+)(?:\\\\\\1\\*)?"
    )
    word = f"\\s*+([^\\s{A}]*+)\\s?"
    other_number = lambda m: f"\\\\{m}\\d*+{END}(?s:.*?)\\\\{m}\\*"
    sections = "|".join(fixed.NOTE_SECTION_MARKERS)
    t = _chain(t, [
        # milestones, figures, categories, sidebars
        (f"\\\\\\+?[A-Za-z]++\\d*+-?+[se]?+(?!\\*)[^\\\\\n{A}]*+\\\\\\*", tag("m")),
        (f"\\\\\\+?fig\\d*+{END}\\s*+(?s:.*?)(?:\\\\fig\\*|\\z)", tag("m")),
        (f"\\\\\\+?cat\\d*+{END}(?s:.*?)(?:\\\\cat\\*|\\z)", ""),
        (f"\\\\\\+?esb{END}(?s:.*?)(?:\\\\\\+?esbe{END}|\\z)", tag("/p")),
        # notes: only cross-reference notes keep their content
        (note("f|fe|ef|efe|ex"), tag("m")),
        (note("x"), tag("x") + "$2" + tag("/x")),
        # chapters, verses and other numberings directly behind them
        (f"\\\\\\+?v\\d*+{END}{word}(?:{other_number('va')}|{other_number('vp')})*+", tag("v:$1")),
        (f"\\\\\\+?c\\d*+{END}{word}(?:\\s*+{other_number('ca')}|\\s*+\\\\cp\\d*+{END}\\s*+[^\\s{A}]*+\\s?)*+",
         tag("/p") + tag("c:$1")),
        (f"\\\\\\+?id\\d*+{END}{word}", tag("/p") + tag("b:$1")),
        (f"\\\\\\+?usfm\\d*+{END}{word}", tag("/p")),
        (f"\\\\\\+?periph\\d*+{END}[^\n]*+", tag("/p") + tag("t")),
        # tables, paragraphs, inline styles
        (f"\\\\tr\\d*+{END}", tag("r")),
        (f"\\\\(?:{'|'.join(fixed.CELL_MARKERS)})(?![A-Za-z])\\d*+(?:-[se]?)?{END}\\s*+", tag("d")),
        (f"\\\\({paragraphs})(?![A-Za-z])(\\d*+(?:-[se]?)?){END}\\s*+", tag("p:$1$2")),
        ("\\\\\\+?([A-Za-z]++\\d*+(?:-[se]?)?)\\*", tag("-$1")),
        ("\\\\\\+?([A-Za-z]++\\d*+(?:-[se]?)?)\\s*+", tag("+$1")),
        ("//", tag("m")),
        ("[ \\t\\n\\x0B\\f\\r]+", " "),
        # attribute lists at the end of an inline style
        (f"\\|[^{A}]*+(?={A}(?:-|/x{Z}|\\+(?:{sections}){Z}))", ""),
    ])
    for _, mark, char in ESCAPES:
        t = F.replace(t, F.lit(mark), F.lit(char))
    return _front_only(tx.escaped(t))


def flat_usx(text: Column) -> Column:
    """A USX text in the flat notation."""
    attr = lambda name: f"(?=[^>]*\\s{name}\\s*=\\s*[\"']([^\"']*)[\"'])"
    gone = lambda name: f"<{name}\\b[^>]*/>|<{name}\\b[^>]*>(?s:.*?)</{name}\\s*>"
    t = _chain(cleaned(text), [
        ("(?s)<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""),
        ("</?usx\\b[^>]*>", ""),
        (f"<chapter\\b{attr('number')}[^>]*>(?:\\s*</chapter>)?", tag("c:$1")),
        (f"<verse\\b{attr('number')}[^>]*>(?:\\s*</verse>)?", tag("v:$1")),
        ("</?(?:chapter|verse)\\b[^>]*>", ""),
        ("<note\\b(?=[^>]*\\sstyle\\s*=\\s*[\"']x[\"'])[^>]*(?<!/)>((?s:.*?))</note\\s*>", tag("x") + "$1" + tag("/x")),
        (f"{gone('note')}|{gone('figure')}", tag("m")),
        (gone("sidebar"), tag("/p")),
        (f"<book\\b{attr('code')}[^>]*/>", tag("b:$1") + tag("/p")),
        (f"<book\\b{attr('code')}[^>]*>", tag("b:$1")),
        (f"<para\\b{attr('style')}[^>]*/>", tag("p:$1") + tag("/p")),
        (f"<para\\b{attr('style')}[^>]*>", tag("p:$1")),
        ("<para\\b[^>]*>", tag("p:")),
        ("</(?:book|para|table)\\s*>", tag("/p")),
        ("<row\\b[^>]*>", tag("r")),
        ("<cell\\b[^>]*>", tag("d")),
        ("<table\\b[^>]*>|</(?:row|cell)\\s*>", ""),
        ("<periph\\b[^>]*>", tag("/p") + tag("t")),
        ("<[A-Za-z][^>]*/>", tag("m")),
        (f"<char\\b{attr('style')}[^>]*>", tag("+$1")),
        ("<([A-Za-z][\\w-]*)[^>]*>", tag("+$1")),
        ("</[^>]*>", tag("-")),
    ])
    return _front_only(tx.escaped(tx.decoded(t)))


def _front_only(flat: Column) -> Column:
    """A peripheral division reaches to the end of its document and is one run of text."""
    front = F.substring_index(flat, tag("t"), 1)
    rest = F.regexp_replace(F.substring(flat, F.char_length(front) + 4, F.char_length(flat)), f"{A}[^+\\-{Z}][^{Z}]*{Z}", "")
    return F.when(flat.contains(tag("t")), F.concat(front, F.lit(tag("t")), rest)).otherwise(flat)


def well_formed(text: Column) -> Column:
    """Whether a text is well-formed XML; a malformed one parses to nothing instead of failing the job."""
    parsed = F.from_xml(text, "__none STRING, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return F.coalesce(tx.let(parsed, lambda p: p["__bad"].isNull() & p.isNotNull()), F.lit(False))


def documents(entries: DataFrame) -> DataFrame:
    """Add ``flat``, ``code``, ``book_ord`` and ``error`` to ``entry, text, format``; the text is dropped."""
    usx = F.col("format") == "usx"
    rooted = F.regexp_replace("text", "(?s)<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>|^\uFEFF", "").rlike("^\\s*<usx[\\s>/]")
    flat = F.when(usx, flat_usx(F.col("text"))).otherwise(flat_usfm(F.col("text")))
    d = computed_once(entries, "flat", flat)
    identified = F.col("flat").rlike(f"^(?:\\s|{tag('/p')})*{A}b:")
    reason = (
        F.when(usx & ~well_formed(F.col("text")), "no XML")
        .when(usx & ~rooted, "no usx root element")
        .when(~usx & ~identified, "no book identification")
    )
    code = F.nullif(F.regexp_extract("flat", f"{A}b:([^{Z}]*){Z}", 1), F.lit(""))
    table = F.expr("str_to_map('" + ",".join(f"{c}:{i}" for i, (_, c) in enumerate(fixed.BOOKS, 1)) + "')")
    return d.withColumns({
        "error": F.when(reason.isNotNull(), F.concat_ws(": ", "entry", reason)),
        "code": code, "book_ord": F.element_at(table, code).cast("int"),
    }).drop("text")


# --- names of a book ----------------------------------------------------------------------------------------------------


def untagged(flat: Column) -> Column:
    """Flat notation as plain text."""
    text = F.regexp_replace(flat, f"{A}[^{Z}]*{Z}", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def book_names(docs: DataFrame) -> DataFrame:
    """Add ``abbreviation, short_name, long_name``: the first filled header of the preferred styles, else the code.

    Headers are read inside the row from the part before the first chapter.
    """
    styles = sorted({s for forms in fixed.NAME_FORMS.values() for s in forms})
    head = F.substring_index("flat", f"{A}c:", 1)
    pattern = F.lit(f"{A}p:({'|'.join(styles)}){Z}((?:[^{A}]++|{A}(?!p:|/p{Z}|b:|r{Z}|t{Z}))*+)")
    d = docs.withColumn("__h", F.zip_with(
        F.regexp_extract_all(head, pattern, F.lit(1)), F.regexp_extract_all(head, pattern, F.lit(2)),
        lambda s, c: F.struct(s.alias("style"), tx.trimmed(untagged(c)).alias("name")),
    ))
    first = lambda style: F.get(F.filter("__h", lambda h: (h["style"] == style) & (h["name"] != "")), F.lit(0))["name"]
    names = {
        form: F.coalesce(*[first(s) for s in styles], F.col("code"), F.lit(""))
        for form, styles in fixed.NAME_FORMS.items()
    }
    return d.withColumns(names).drop("__h")


# --- inline markup --------------------------------------------------------------------------------------------------------


def is_text_free(style: Column) -> Column:
    """Styles of paragraphs that are no scripture text: introductions, headers, headings, titles, labels, remarks."""
    return style.rlike(f"^(?:i.*|(?:{'|'.join(fixed.TEXT_FREE_STYLES)})\\d*)$")


def _inline(style: Column) -> Column:
    table = F.expr("str_to_map('" + ",".join(f"{s}:{t}" for s, t in fixed.INLINE_TAGS.items()) + "')")
    return F.element_at(table, style)


def render(flat: Column, trim_end: Column) -> Column:
    """``STRUCT<markup, notes>`` of the flat text of one verse in one paragraph.

    A fold over its tokens with the open styles as state.  Pieces are the children of the paragraph; blank ones before
    the first filled piece are layout.  ``notes`` lists which of its notes stand directly in the paragraph.
    """
    tokens = F.regexp_extract_all(flat, F.lit(f"{A}[^{Z}]*{Z}|[^{A}]+"), F.lit(0))
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = F.struct(
        F.lit("").alias("out"), F.lit("").alias("piece"), strings.alias("open"), F.lit(0).alias("seen"),
        numbers.alias("notes"), F.lit(False).alias("text_last"),
    )
    closing = lambda styles: F.array_join(
        F.transform(F.reverse(styles), lambda s: F.coalesce(F.concat(F.lit("</"), _inline(s), F.lit(">")), F.lit(""))), ""
    )

    def kept(out, piece):
        return F.when((out == "") & tx.is_blank(piece), out).otherwise(F.concat(out, piece))

    def state(s, **new):
        return F.struct(*[new.get(k, s[k]).alias(k) for k in ("out", "piece", "open", "seen", "notes", "text_last")])

    def step(s, t):
        kind, top = F.substring(t, 1, 2), F.size(s["open"]) == 0
        style = F.substring(t, 3, F.char_length(t) - 3)
        out = F.when(top, kept(s["out"], s["piece"])).otherwise(s["out"])
        piece = F.when(top, F.lit("")).otherwise(s["piece"])
        no = F.lit(False)
        opened = state(
            s, out=out, piece=F.concat(piece, F.coalesce(F.concat(F.lit("<"), _inline(style), F.lit(">")), F.lit(""))),
            open=F.concat(s["open"], F.array(style)), text_last=no,
        )
        # A close by name ends the styles opened since too; without a name it ends the last one.
        depth = F.size(s["open"])
        at = F.when(style == "", depth).otherwise(
            F.when(F.array_contains(s["open"], style), depth - F.array_position(F.reverse(s["open"]), style) + 1)
        ).cast("int")

        def close(p):
            rest = F.slice(s["open"], F.lit(1), p - 1)
            ended = F.concat(s["piece"], closing(F.slice(s["open"], p, depth)))
            return F.when(p == 1, state(s, out=kept(s["out"], ended), piece=F.lit(""), open=rest, text_last=no)).otherwise(
                state(s, piece=ended, open=rest, text_last=no)
            )

        closed = tx.let(at, lambda p: F.when(p.isNull() | (p < 1), state(s)).otherwise(close(p)))
        note = state(
            s, out=out, piece=piece, seen=s["seen"] + 1,
            notes=F.when(top, F.concat(s["notes"], F.array(s["seen"]))).otherwise(s["notes"]), text_last=no,
        )
        return (
            F.when(kind == A + "+", opened).when(kind == A + "-", closed).when(kind == A + "n", note)
            .when(F.substring(t, 1, 1) == A, state(s, out=out, piece=piece, text_last=no))
            .otherwise(state(s, piece=F.concat(s["piece"], t), text_last=F.lit(True)))
        )

    def finish(s):
        bare = (F.size(s["open"]) == 0) & s["text_last"] & trim_end
        piece = F.when(bare, F.rtrim(s["piece"])).otherwise(F.concat(s["piece"], closing(s["open"])))
        return F.struct(kept(s["out"], piece).alias("markup"), s["notes"].alias("notes"))

    plain = F.when(trim_end, F.rtrim(flat)).otherwise(flat)
    simple = F.struct(F.when(tx.is_blank(plain), F.lit("")).otherwise(plain).alias("markup"), numbers.alias("notes"))
    return F.when(flat.contains(A), F.aggregate(tokens, start, step, finish)).otherwise(simple)


NOTE = f"{A}x{Z}((?:[^{A}]++|{A}(?!/x{Z}))*+){A}/x{Z}"


def _note_references(note: Column) -> Column:
    """Target references of one cross-reference note."""
    sections = "|".join(fixed.NOTE_SECTION_MARKERS)
    target = f"{A}\\+xt{Z}((?:[^{A}]++|{A}(?!\\+(?:{sections}){Z}|-xt{Z}|-{Z}))*+)"
    texts = F.transform(F.regexp_extract_all(note, F.lit(target), F.lit(1)), untagged)
    return F.filter(texts, lambda t: t != "")


def attributes(style: Column, text: Column) -> Column:
    """``MAP`` of an attribute list like ``lemma="grace"``; a bare value goes to the default attribute of its style."""
    pattern = F.lit('([\\w\\-]+)\\s*=\\s*"([^"]*)"')
    rename = lambda k: F.when(k == "src", fixed.RENAMED_ATTRIBUTES["src"]).otherwise(k)
    keys = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), rename)
    values = F.regexp_extract_all(text, pattern, F.lit(2))
    # The last of equal keys counts.
    listed = F.map_from_entries(F.filter(
        F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda e: F.lit(True)
    ))
    table = F.expr("str_to_map('" + ",".join(f"{s}:{a}" for s, a in fixed.DEFAULT_ATTRIBUTES.items()) + "')")
    default = F.element_at(table, style)
    empty = F.create_map().cast("map<string,string>")
    bare = F.when(default.isNotNull() & (F.trim(text) != ""), F.create_map(default, F.trim(text))).otherwise(empty)
    return F.when(F.size(keys) > 0, listed).otherwise(bare)


# --- verses ----------------------------------------------------------------------------------------------------------------


def marker_number(text: Column) -> Column:
    """The number a chapter or verse marker begins with, 0 for none."""
    return F.coalesce(F.regexp_extract(text, "^\\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def marker_last(text: Column) -> Column:
    """The highest number of a marker, e.g. 4 of ``2-4``; beyond any chapter where it does not fit."""
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda n: F.coalesce(n.try_cast("int"), F.lit(2**31 - 1))
    )
    return F.coalesce(F.array_max(numbers), F.lit(0))


def units(docs: DataFrame) -> DataFrame:
    """Verse units: the text between two verse markers of one block of one chapter.  Narrow, no shuffle."""
    keys = [*KEYS, "format"]
    chunks = F.split("flat", f"{A}c:", -1)
    d = docs.where("error is null and book_ord is not null").select(
        *keys, F.posexplode_outer(F.slice(chunks, F.lit(2), F.size(chunks))).alias("chapter_idx", "chunk")
    ).where("chunk is not null")
    number = F.substring_index("chunk", Z, 1)
    body = F.substring(F.col("chunk"), F.char_length(number) + 2, F.char_length("chunk"))
    d = d.select(*keys, "chapter_idx", marker_number(number).alias("chapter"), body.alias("body")).where("chapter > 0")
    d = d.select(
        *keys, "chapter_idx", "chapter", F.posexplode_outer(F.split("body", f"(?={BLOCK})", -1)).alias("block", "raw")
    )
    head = F.regexp_extract("raw", f"^{A}(p:[^{Z}]*|/p|b:[^{Z}]*|r|t){Z}", 1)
    d = d.withColumn("head", head)
    kind = F.when(F.col("head").startswith("p:"), "P").when(F.col("head").isin("", "/p"), "N").otherwise("T")
    text = F.when(F.col("head") == "", F.col("raw")).otherwise(
        F.substring(F.col("raw"), F.char_length("head") + 3, F.char_length("raw"))
    )
    d = d.select(*keys, "chapter_idx", "chapter", "block", kind.alias("kind"), "head", text.alias("text"))
    free = (F.col("kind") == "P") & is_text_free(F.substring(F.col("head"), 3, F.char_length("head")))
    d = d.where(~free)
    # Rows and divisions are one run of text: verse markers inside do not count, cells end without white space.
    cells = F.regexp_replace("text", f"{A}v:[^{Z}]*{Z}", "")
    cells = F.when(F.col("format") == "usfm", F.regexp_replace(cells, f"\\s+(?={A}d{Z}|\\z)", "")).otherwise(cells)
    pieces = F.when(F.col("kind") == "T", F.array(F.replace(cells, F.lit(tag("d")), F.lit("")))).otherwise(
        F.split("text", f"(?={A}v:)", -1)
    )
    d = d.select(
        *keys, "chapter_idx", "chapter", "block", "kind", F.size(pieces).alias("n"),
        F.posexplode_outer(pieces).alias("unit", "piece"),
    )
    marker = F.when(F.col("piece").startswith(f"{A}v:"), F.substring(F.substring_index("piece", Z, 1), 4, 2**31 - 1))
    d = d.withColumn("marker", marker)
    return d.withColumn(
        "piece",
        F.when(F.col("marker").isNotNull(), F.substring(F.col("piece"), F.char_length("marker") + 5, F.char_length("piece")))
        .otherwise(F.col("piece")),
    ).where(F.col("marker").isNotNull() | (F.col("piece") != ""))


def verse_rows(docs: DataFrame) -> DataFrame:
    """``file, entry_idx, book_ord, chapter, verse, markup, cross_references`` of every verse a document numbers."""
    d = units(docs)
    notes = F.regexp_extract_all("piece", F.lit(NOTE), F.lit(1))
    trim_end = (F.col("format") == "usfm") & (F.col("kind") == "P") & (F.col("unit") == F.col("n") - 1)
    d = d.select(
        *KEYS, "chapter_idx", "chapter", "block", "kind", "unit", "marker", notes.alias("note_texts"),
        render(F.regexp_replace("piece", NOTE, tag("n")), trim_end).alias("r"),
    )
    refs = F.flatten(F.transform("r.notes", lambda i: _note_references(F.get(F.col("note_texts"), i))))
    d = d.select(
        *KEYS, "chapter_idx", "chapter", "block", "kind", "unit", F.col("r.markup").alias("content"),
        F.when(F.size("r.notes") > 0, refs).otherwise(F.array().cast("array<string>")).alias("refs"),
        F.when(F.col("marker").isNotNull(), F.struct(
            marker_number(F.col("marker")).alias("verse"), marker_last(F.col("marker")).alias("last")
        )).alias("marker"),
    )
    # The one shuffle: everything below is keyed by document and chapter.
    d = d.repartition(*KEYS, "chapter")
    chapter = [*KEYS, "chapter", "chapter_idx"]
    run = Window.partitionBy(*chapter).orderBy("block", "unit").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({
        "occ": F.count("marker").over(run), "current": F.last("marker", ignorenulls=True).over(run),
    }).where("current.verse > 0")
    before = Window.partitionBy(*chapter, "block").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.max((F.col("content") != "").cast("int")).over(before), F.lit(0)) > 0
    position = F.when(F.col("kind") != "P", "undefined").when(filled, "continue").otherwise("begin")
    d = d.withColumn("part", F.struct("block", "unit", position.alias("position"), "content", "refs"))
    d = d.groupBy(*chapter, "occ").agg(
        F.first("current").alias("current"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    markup, refs = _assembled(F.filter("parts", lambda p: p["content"] != "")), F.flatten(F.col("parts.refs"))
    d = d.select(*chapter, "occ", "current", markup.alias("markup"), refs.alias("refs"))
    first = F.struct(F.col("current.verse").alias("verse"), F.col("markup"), F.col("refs"))
    last = F.col("current.last")
    bridge = (last > F.col("current.verse")) & (last <= fixed.LONGEST_CHAPTER)
    covered = F.when(bridge, F.transform(
        F.sequence(F.col("current.verse") + 1, last),
        lambda v: F.struct(v.alias("verse"), F.lit("").alias("markup"), F.array().cast("array<string>").alias("refs")),
    )).otherwise(F.array().cast("array<struct<verse:int,markup:string,refs:array<string>>>"))
    d = d.select(*chapter, "occ", F.inline_outer(F.concat(F.array(first), covered)))
    order = F.struct("chapter_idx", "occ")
    filled_first = F.struct(F.col("markup") == "", F.col("chapter_idx"), F.col("occ"))
    d = d.groupBy(*KEYS, "chapter", "verse").agg(
        F.min_by("markup", filled_first).alias("markup"), F.min_by("refs", filled_first).alias("r1"),
        F.min_by("refs", order).alias("r0"),
    )
    refs = F.when(F.size("r1") > 0, F.col("r1")).otherwise(F.col("r0"))
    return d.select(*KEYS, "chapter", "verse", "markup", refs.alias("cross_references"))


def _assembled(parts: Column) -> Column:
    """Sections of a verse; runs of text outside paragraphs that follow each other are one section."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("loose"))
    closed = lambda s: F.when(
        s["loose"] == "", s["out"]
    ).otherwise(F.concat(s["out"], tx.section(F.lit("undefined"), s["loose"])))

    def step(s, p):
        return F.when(
            p["position"] == "undefined",
            F.struct(s["out"].alias("out"), F.concat(s["loose"], p["content"]).alias("loose")),
        ).otherwise(F.struct(
            F.concat(closed(s), tx.section(p["position"], p["content"])).alias("out"), F.lit("").alias("loose")
        ))

    return F.aggregate(parts, start, step, closed)


def first_file_per_book(verses: DataFrame) -> DataFrame:
    """Of several documents of one book in an archive the first one with verses counts."""
    w = Window.partitionBy("file", "book_ord").orderBy("entry_idx")
    return verses.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")
