"""Scripture metadata files: project settings, bundle metadata and copyright pages, read in bulk as Columns.

Each reader returns ``STRUCT<name, abbreviation, language, copyright>``, null if the file does not read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from .markup import well_formed

INFO = "struct<name:string,abbreviation:string,language:string,copyright:string>"
# The files that tell about a scripture in the order they are asked.
INFO_FILES = [("Settings.xml", "paratext"), ("metadata.xml", "dbl"), ("copr.htm", "ebible")]
# Entities of HTML that XML does not know.
HTML_ENTITIES = {"nbsp": 160, "copy": 169, "reg": 174, "ndash": 8211, "mdash": 8212}


def _info(name: Column, abbreviation: Column, language: Column, copyright: Column) -> Column:
    return F.struct(
        name.alias("name"), abbreviation.alias("abbreviation"), language.alias("language"), copyright.alias("copyright")
    )


def _bare(xml: Column) -> Column:
    return F.regexp_replace(xml, "(?s)<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")


def _text(inner: Column) -> Column:
    return tx.decoded(F.regexp_replace(inner, "<[^>]*>", ""))


def _elements(xml: Column) -> Column:
    """``ARRAY<STRUCT<path, depth, begin, end>>``: the elements of a small XML file in the order they close.

    A fold over the tags keeps the open path and the offset behind each opening tag, so the text of an element is a
    substring taken only for the few elements asked for.
    """
    tokens = F.regexp_extract_all(xml, F.lit("<[^>]*>|[^<]+"), F.lit(0))
    start = F.struct(
        F.array().cast("array<struct<path:string,begin:int>>").alias("open"),
        F.array().cast("array<struct<path:string,depth:int,begin:int,end:int>>").alias("done"),
        F.lit(0).alias("pos"),
    )

    def step(s, t):
        size, depth = F.char_length(t), F.size(s["open"])
        behind = s["pos"] + size
        top = F.get(s["open"], depth - 1)
        path = F.concat(F.coalesce(top["path"], F.lit("")), F.lit("/"), F.regexp_extract(t, "^<\\s*([^\\s/>]+)", 1))
        element = lambda p, d, a, b: F.array(F.struct(
            p.alias("path"), d.alias("depth"), a.alias("begin"), b.alias("end")
        ))
        state = lambda opened, done: F.struct(opened.alias("open"), done.alias("done"), behind.alias("pos"))
        closed = state(
            F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0))),
            F.concat(s["done"], element(top["path"], depth - 1, top["begin"], s["pos"])),
        )
        return (
            F.when(F.startswith(t, F.lit("</")) & (depth > 0), closed)
            .when(~F.startswith(t, F.lit("<")) | F.startswith(t, F.lit("</")), state(s["open"], s["done"]))
            .when(F.endswith(t, F.lit("/>")), state(s["open"], F.concat(s["done"], element(path, depth, behind, behind))))
            .otherwise(state(F.concat(s["open"], F.array(F.struct(path.alias("path"), behind.alias("begin")))), s["done"]))
        )

    return F.aggregate(tokens, start, step, lambda s: s["done"])


def _shown(xml: Column, element: Column) -> Column:
    return F.trim(_text(F.substring(xml, element["begin"] + 1, element["end"] - element["begin"])))


def paratext(text: Column) -> Column:
    """Project settings: ``FullName``, ``Name``, ``Language`` and ``Copyright`` directly below the root."""
    def read(e):
        child = lambda name: _shown(_bare(text), F.get(F.filter(
            e, lambda x: (x["depth"] == 1) & F.endswith(x["path"], F.lit("/" + name))
        ), F.lit(0)))
        return _info(child("FullName"), child("Name"), child("Language"), child("Copyright"))

    return F.when(well_formed(text), tx.let(_elements(_bare(text)), read))


# Where bundle metadata holds each value, the preferred places first.
DBL_PATHS = {
    "name": [["identification/nameLocal"], ["identification/name"], ["name"]],
    "abbreviation": [["identification/abbreviationLocal"], ["identification/abbreviation"], ["abbreviation"]],
    "language": [["language/nameLocal"], ["language/name"], ["language"]],
    "copyright": [["copyright", "statementContent"], ["copyright"]],
}


def dbl(text: Column) -> Column:
    """Bundle metadata: for each place in order the element closest to the root whose path holds its sections."""
    none = F.lit(None).cast("struct<path:string,depth:int,begin:int,end:int>")

    def read(e):
        def at(sections):
            pattern = ".*".join(f"\\Q{s}\\E" for s in sections)
            nearest = F.aggregate(
                F.filter(e, lambda x: x["path"].rlike(pattern)), none,
                lambda best, x: F.when(best.isNull() | (x["depth"] < best["depth"]), x).otherwise(best),
            )
            return _shown(_bare(text), nearest)

        return _info(*[F.coalesce(*[at(p) for p in places]) for places in DBL_PATHS.values()])

    return F.when(well_formed(text), tx.let(_elements(_bare(text)), read))


def ebible(text: Column) -> Column:
    """Copyright page: heading, translation in the link of its table of contents, language, first paragraph.

    Such pages are no XML, so tags and texts are taken one after the other instead of as a tree.
    """
    tokens = F.regexp_extract_all(text, F.lit("<[^>]*>|[^<]+"), F.lit(0))

    # A tag with its name, a text with an empty one.
    named = F.transform(tokens, lambda x, i: F.struct(
        (i + 1).alias("at"), F.lower(F.regexp_extract(x, "^<(/?[A-Za-z][A-Za-z0-9]*)", 1)).alias("name"), x.alias("shown")))

    def read(t):
        def first(begin, meets):
            """The first place from ``begin`` on whose token meets a condition."""
            return F.get(F.filter(t, lambda x: (x["at"] >= begin) & meets(x)), F.lit(0))["at"]

        def within(begin, end, cut=()):
            """The text behind the tag at ``begin`` up to the tag ``end``, or to a tag of ``cut``; null without an end."""
            stop = first(begin + 1, lambda x: x["name"] == end)
            until = first(begin + 1, lambda x: x["name"].isin([end, *cut]))
            inner = F.filter(F.slice(t, begin + 1, F.greatest(until - begin - 1, F.lit(0))), lambda x: ~x["shown"].startswith("<"))
            return F.when(begin.isNotNull() & stop.isNotNull(), F.array_join(F.transform(inner, lambda x: x["shown"]), ""))

        places = F.struct(
            first(F.lit(1), lambda x: x["name"] == "h1").alias("heading"), first(F.lit(1), lambda x: x["name"] == "p").alias("paragraph"),
            first(F.lit(1), lambda x: x["shown"].rlike("^<[^>]*class=[\"']toc[\"']")).alias("contents"),
            first(F.lit(1), lambda x: x["shown"].rlike("Language:\\s*$")).alias("label"))

        def found(at):
            link = first(at["contents"] + 1, lambda x: x["shown"].rlike("\\S"))
            address = F.regexp_extract(F.get(t, link - 1)["shown"], "^<a\\s[^>]*href=[\"'][^\"']*/([\\w-]+)[\"']", 1)
            language = tx.let(at["label"] + 1, lambda a: F.regexp_replace(shown(within(a, "/a")), "\\(.*\\)$", ""))
            return _info(
                shown(within(at["heading"], "/h1")), F.nullif(address, F.lit("")),
                F.when(F.get(t, at["label"])["name"] == "a", F.trim(language)), shown(within(at["paragraph"], "/p", ["br"])))

        return tx.let(places, found)

    def shown(fragment):
        known = fragment
        for name, code in HTML_ENTITIES.items():
            known = F.replace(known, F.lit(f"&{name};"), F.lit(chr(code)))
        return tx.let(known, lambda k: F.nullif(F.trim(tx.decoded(k)), F.lit("")))

    return tx.let(named, read)


READERS = {"paratext": paratext, "dbl": dbl, "ebible": ebible}


def file_stem(file: Column) -> Column:
    return F.regexp_replace(file, "\\.[^.]*$", "")
