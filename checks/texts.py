"""Extraction of citations and text functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.functions import refs
from versewright.functions import text as tx
from versewright.operators import extract, versify
from versewright.plans import pipelines

from .base import ORD, books_cte, chapter_table, chapters, flat, lit, query, table, vers_cte, verse_refs

# The text of every document with one citation added: name, chapter, verse and form are picked by its number.
FORMS = 6


def _names_cte() -> str:
    rows = ", ".join(
        f"({lit(lang)}, {i}, {b}, {lit(n)})" for lang in ("en", "de") for i, (b, n) in enumerate(fixed.names_of(lang))
    )
    return f"names(lang, i, book_ord, name) AS (VALUES {rows})"


CITED_SQL = f"""{_names_cte()}, {vers_cte('esv')},
picked AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS lang, doc_id % {FORMS} AS form,
  CASE WHEN doc_id % 2 = 0 THEN doc_id * 7 % 143 ELSE doc_id * 7 % 133 END AS i FROM documents),
named AS (SELECT p.*, n.book_ord, n.name FROM picked p JOIN names n ON n.lang = p.lang AND n.i = p.i),
placed AS (SELECT n.*, 1 + doc_id % (SELECT max(chapter) FROM vers v WHERE v.book_ord = n.book_ord) AS c FROM named n),
numbered AS (SELECT p.*, v.last_verse, 1 + doc_id % v.last_verse AS a,
  least(1 + doc_id % v.last_verse + 2, v.last_verse) AS b FROM placed p JOIN vers v ON v.book_ord = p.book_ord AND v.chapter = p.c),
written AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN replace(name, '1', 'l') WHEN doc_id % 5 = 1 AND length(name) > 3
    THEN left(name, 3) || '-' || chr(10) || substr(name, 4) ELSE name END AS spelled,
  CASE form WHEN 0 THEN c || ',' || a WHEN 1 THEN c || ', ' || a || ' - ' || b WHEN 2 THEN c || ':' || a || '.' || b
    WHEN 3 THEN c::VARCHAR WHEN 4 THEN c || ',' || a || 'f.' ELSE c || ',' || a || '-' || c || ',' || b END AS passage
  FROM numbered),
cited AS (SELECT *, text || ' (' || spelled || ' ' || passage || ') und' AS whole,
  length(text) + 2 AS begin_at,
  length(text) + 2 + length(spelled) + 1 + length(passage) - CASE WHEN form = 4 THEN 2 ELSE 0 END AS end_at,
  CASE WHEN form = 3 THEN 1 ELSE a END AS first_verse,
  CASE WHEN form IN (0, 4) THEN a WHEN form = 3 THEN last_verse ELSE b END AS last_of
  -- A shorter spelling is tried first and leaves a letter before the number, which is then no passage.
  FROM written WHERE name NOT IN ('Ezra', 'Esra'))"""


def cited(spark, sf_dir):
    """``doc_id, lang, text`` with the citation added."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    name = book = None
    for lang in ("en", "de"):
        listed = fixed.names_of(lang)
        i = (F.col("doc_id") * 7 % len(listed)).cast("int")
        this_name = F.get(F.array(*[F.lit(n) for _, n in listed]), i)
        this_book = F.get(F.array(*[F.lit(b) for b, _ in listed]), i)
        name = this_name if name is None else F.when(F.col("lang") == "de", this_name).otherwise(name)
        book = this_book if book is None else F.when(F.col("lang") == "de", this_book).otherwise(book)
    per_book = dims.book_chapters(chapter_table(spark, "esv")).drop("vers_name")
    d = d.withColumns({"name": name, "book_ord": book}).join(F.broadcast(per_book), "book_ord")
    d = d.withColumn("c", F.lit(1) + F.col("doc_id") % F.col("chapter_count"))
    d = d.withColumn("last", F.element_at("last_verses", F.col("c").cast("int")))
    d = d.withColumn("a", F.lit(1) + F.col("doc_id") % F.col("last"))
    d = d.withColumn("b", F.least(F.col("a") + 2, F.col("last")))
    passage = F.expr(f"""case doc_id % {FORMS} when 0 then c || ',' || a when 1 then c || ', ' || a || ' - ' || b
      when 2 then c || ':' || a || '.' || b when 3 then string(c) when 4 then c || ',' || a || 'f.'
      else c || ',' || a || '-' || c || ',' || b end""")
    spelled = F.expr("""case when doc_id % 5 = 0 then replace(name, '1', 'l') when doc_id % 5 = 1 and length(name) > 3
      then left(name, 3) || '-' || char(10) || substr(name, 4) else name end""")
    whole = F.concat("text", F.lit(" ("), spelled, F.lit(" "), passage, F.lit(") und"))
    return d.select("doc_id", "lang", F.lit("esv").alias("vers_name"), whole.alias("text"),
                    (F.char_length("text") + 2).alias("name_at"))


@query("citations_in_text", f"""WITH {CITED_SQL}
SELECT doc_id, CAST(begin_at AS INTEGER) AS "begin", CAST(end_at AS INTEGER) AS "end", book_ord AS fb, CAST(c AS INTEGER) AS fc,
  CAST(first_verse AS INTEGER) AS fv, book_ord AS tb, CAST(c AS INTEGER) AS tc,
  CAST(CASE WHEN form = 2 THEN a ELSE last_of END AS INTEGER) AS tv FROM cited
UNION ALL SELECT doc_id, CAST(begin_at AS INTEGER), CAST(end_at AS INTEGER), book_ord, CAST(c AS INTEGER), CAST(b AS INTEGER),
  book_ord, CAST(c AS INTEGER), CAST(b AS INTEGER) FROM cited WHERE form = 2""")
def citations_in_text(spark, sf_dir):
    d = extract.find_citations(cited(spark, sf_dir), chapters("esv"), "text", F.col("lang"), F.col("vers_name"))
    return flat(d.select("doc_id", "begin", "end", F.explode("ranges").alias("r")), "r")


@query("citation_counts", f"""WITH {CITED_SQL}
SELECT book_ord, count(*) + count(*) FILTER (form = 2) AS ranges,
  CAST(sum(CASE WHEN form = 2 THEN 2 ELSE last_of - first_verse + 1 END) AS BIGINT) AS verses
FROM cited GROUP BY book_ord""")
def citation_counts(spark, sf_dir):
    return pipelines.citation_counts(cited(spark, sf_dir), F.col("lang"))


# One name a book and language that isn't the one whose shorter spelling leaves a letter.
PLAIN_NAMES = {
    lang: {b: n for b, n in reversed(fixed.names_of(lang)) if n not in ("Ezra", "Esra")} for lang in ("de", "en")
}
PLAIN_BOOKS = ", ".join(str(b) for b in range(1, 67) if all(b in names for names in PLAIN_NAMES.values()))


@query("several_citations", f"""WITH {vers_cte('kjv')}
SELECT l_orderkey, book_ord AS fb, chapter AS fc, verse AS fv, book_ord AS tb, chapter AS tc, verse AS tv
FROM lineitem JOIN verse ON verse_ord = {ORD} WHERE book_ord IN ({PLAIN_BOOKS})""")
def several_citations(spark, sf_dir):
    """Texts of an order each, citing a verse for every line item, in both languages."""
    d = verse_refs(spark, sf_dir).where(f"book_ord in ({PLAIN_BOOKS})")
    lang = F.when(F.col("l_orderkey") % 2 == 0, "de").otherwise("en")
    named = F.when(lang == "de", _named("de", "book_ord")).otherwise(_named("en", "book_ord"))
    one = F.concat_ws("", named, F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse"))
    texts = d.groupBy("l_orderkey", lang.alias("lang")).agg(F.array_join(F.array_sort(F.collect_list(one)), " oder ").alias("text"))
    found = extract.find_citations(texts, chapters("kjv"), "text", F.col("lang"), "kjv")
    return flat(found.select("l_orderkey", F.explode("ranges").alias("r")), "r")


@query("chapter_ranges", f"""WITH {vers_cte('kjv')}, r AS (SELECT l_orderkey, l_linenumber, v.book_ord, v.chapter AS c, v.chapter + 1 AS d, n.last_verse
  FROM lineitem JOIN verse v ON v.verse_ord = {ORD} JOIN vers n ON n.book_ord = v.book_ord AND n.chapter = v.chapter + 1 WHERE v.book_ord IN ({PLAIN_BOOKS}))
SELECT l_orderkey, l_linenumber, book_ord AS fb, c AS fc, 1 AS fv, book_ord AS tb, d AS tc,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN last_verse ELSE 1 + l_orderkey % last_verse END AS INTEGER) AS tv FROM r""")
def chapter_ranges(spark, sf_dir):
    """From a chapter to the next one or to a verse in it: ``Name 3-4`` and ``Name 3-4,5``."""
    kjv = chapters("kjv")
    d = verse_refs(spark, sf_dir).where(f"book_ord in ({PLAIN_BOOKS})")
    d = d.join(F.broadcast(dims.book_chapters(chapter_table(spark, "kjv"))), ["vers_name", "book_ord"]).where("chapter < chapter_count")
    verse = F.concat(F.lit(","), F.lit(1) + F.col("l_orderkey") % F.element_at("last_verses", F.col("chapter") + 1))
    text = F.concat(_named("de", "book_ord"), F.lit(" "), F.col("chapter"), F.lit("-"), F.col("chapter") + 1,
                    F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(verse), F.lit(" lesen"))
    d = d.select("l_orderkey", "l_linenumber", text.alias("text"))
    found = extract.find_citations(d, kjv, "text", "de", "kjv", recurring=True)
    return flat(found.select("l_orderkey", "l_linenumber", F.explode("ranges").alias("r")), "r")


@query("verse_level_ranges", f"""WITH {vers_cte('kjv')}, r AS (SELECT l_orderkey, l_linenumber, v.book_ord AS b, v.chapter AS c, v.verse AS v1, v.last_verse AS last,
  l_linenumber % 2 = 0 AS crossing, n.chapter IS NOT NULL AS followed
  FROM lineitem JOIN verse v ON v.verse_ord = {ORD} LEFT JOIN vers n ON n.book_ord = v.book_ord AND n.chapter = v.chapter + 1 WHERE v.book_ord IN ({PLAIN_BOOKS})),
k AS (SELECT * FROM r WHERE v1 + 2 <= last AND (followed OR NOT crossing))
SELECT l_orderkey, l_linenumber, b AS fb, c AS fc, v1 AS fv, b AS tb, c AS tc, v1 AS tv FROM k
UNION ALL SELECT l_orderkey, l_linenumber, b, c, CAST(v1 + 1 AS INTEGER), b, CAST(CASE WHEN crossing THEN c + 1 ELSE c END AS INTEGER),
  CAST(CASE WHEN crossing THEN 1 ELSE v1 + 2 END AS INTEGER) FROM k""")
def verse_level_ranges(spark, sf_dir):
    """A verse and then, in its chapter, a range or one into the next chapter: ``Name 3,16a.17-18b`` and ``Name 3,16.17-4,1``."""
    kjv = chapters("kjv")
    d = verse_refs(spark, sf_dir).where(f"book_ord in ({PLAIN_BOOKS})")
    d = versify.verse_count(d, kjv).withColumn("crossing", F.col("l_linenumber") % 2 == 0)
    d = d.join(F.broadcast(versify.chapter_counts(chapter_table(spark, "kjv"))), ["vers_name", "book_ord"])
    d = d.where("verse + 2 <= verse_count and (not crossing or chapter < chapter_count)")
    v = F.col("verse")
    crossing = F.concat(v, F.lit("."), v + 1, F.lit("-"), F.col("chapter") + 1, F.lit(",1"))
    within = F.concat(v, F.lit("a."), v + 1, F.lit("-"), v + 2, F.lit("b"))
    text = F.concat(_named("de", "book_ord"), F.lit(" "), F.col("chapter"), F.lit(","), F.when(F.col("crossing"), crossing).otherwise(within), F.lit(" lesen"))
    found = extract.find_citations(d.select("l_orderkey", "l_linenumber", text.alias("text")), kjv, "text", "de", "kjv", recurring=True)
    return flat(found.select("l_orderkey", "l_linenumber", F.explode("ranges").alias("r")), "r")


def _named(lang, book):
    names = PLAIN_NAMES[lang]
    return F.get(F.array(*[F.lit(names.get(b)) for b in range(1, 67)]), F.col(book) - 1)


@query("citation_at_position", f"""WITH {CITED_SQL},
-- Of a name that isn't followed by a passage only the shorter spelling itself is a match.
spans AS (SELECT doc_id, form, begin_at, end_at, CASE WHEN form = 2 THEN 2 ELSE 1 END AS n, end_at AS shown_end FROM cited
  UNION ALL SELECT doc_id, form, length(text) + 2, length(text) + 2 + length(spelled) + 1 + length(passage) - CASE WHEN form = 4 THEN 2 ELSE 0 END, 0,
    length(text) + 2 + length(spelled) - 1 FROM written WHERE name IN ('Ezra', 'Esra')),
asked AS (SELECT *, begin_at + CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN end_at - begin_at - 1
  ELSE end_at - begin_at + CASE WHEN form = 4 THEN 5 ELSE 3 END END AS idx FROM spans)
SELECT doc_id, idx < shown_end AS hit, CAST(CASE WHEN idx < shown_end THEN begin_at END AS INTEGER) AS begin_at,
  CAST(CASE WHEN idx < shown_end THEN n ELSE 0 END AS INTEGER) AS n FROM asked""")
def citation_at_position(spark, sf_dir):
    d = cited(spark, sf_dir)
    end = F.char_length("text") - F.when(F.col("doc_id") % FORMS == 4, 7).otherwise(5)
    idx = F.when(F.col("doc_id") % 3 == 0, F.col("name_at")).when(F.col("doc_id") % 3 == 1, end - 1).otherwise(
        end + F.when(F.col("doc_id") % FORMS == 4, 5).otherwise(3)
    )
    d = extract.parse_at(d.withColumn("idx", idx), chapters("esv"), "text", "idx", F.col("lang"), F.col("vers_name"))
    return d.select("doc_id", F.col("origin").isNotNull().alias("hit"), F.col("origin.begin").alias("begin_at"),
                    F.size("ranges").alias("n"))


@query("first_citation", f"""WITH {CITED_SQL}, {books_cte()}
SELECT doc_id, book_id || ' ' || c || ', ' || first_verse AS first FROM cited JOIN books USING (book_ord)""")
def first_citation(spark, sf_dir):
    d = extract.find_citations(cited(spark, sf_dir), chapters("esv"), "text", F.col("lang"), F.col("vers_name"))
    return d.select("doc_id", refs.format_ref(F.element_at("ranges", 1)["from"]).alias("first"))


@query("passage_separators", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey || ',' || l_suppkey || '-' ||
  (l_suppkey + 1) || ';' || l_linenumber || ',' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '.7' ELSE '' END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, t AS template, CASE WHEN l_linenumber % 2 = 0 THEN ',;.' ELSE ',;' END AS separators,
  CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END AS sections FROM t""")
def passage_separators(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", """l_partkey || ', ;' || l_suppkey || 'f. - ' ||
      (l_suppkey + 1) || '; ' || l_linenumber || ',' || l_partkey || case when l_linenumber % 2 = 0 then '.7' else '' end as p""")
    t = extract.template(F.col("p"))
    return d.select(
        "l_orderkey", "l_linenumber", t.alias("template"), F.array_join(extract.separators(t), "").alias("separators"),
        F.size(extract.sections(t, F.lit(","))).alias("sections"),
    )


def _re2(lang: str) -> str:
    """The pattern of names without what RE2 lacks: where a name begins, the shorter one is taken either way."""
    return tx.name_pattern(lang).replace("*+", "*")


def _folded_names(lang: str) -> str:
    return ", ".join(f"('{lang}', {lit(extract._folded(n))}, {b})" for n, b in {n: b for b, n in fixed.names_of(lang)}.items())


@query("book_name_occurrences", f"""WITH {CITED_SQL}, names_folded(lang, folded, book_ord) AS (VALUES {_folded_names('de')}, {_folded_names('en')}),
whole AS (SELECT doc_id, lang, text || ' (' || spelled || ' ' || passage || ') und' AS whole FROM written),
found AS (SELECT doc_id, lang, unnest(CASE WHEN lang = 'de' THEN regexp_extract_all(whole, {lit(_re2('de'))})
  ELSE regexp_extract_all(whole, {lit(_re2('en'))}) END) AS name FROM whole)
SELECT doc_id, n.book_ord, count(*) AS n FROM found f JOIN names_folded n ON n.lang = f.lang
  AND n.folded = translate(regexp_replace(f.name, {lit(f"[{tx.DROPPED}]")}, '', 'g'), '0OIlmS', 'oo11Ms') GROUP BY ALL""")
def book_name_occurrences(spark, sf_dir):
    d = cited(spark, sf_dir).select("doc_id", "lang", "text")
    found = [extract.name_occurrences(d.where(F.col("lang") == lang), "text", lang) for lang in ("de", "en")]
    return found[0].unionByName(found[1]).groupBy("doc_id", "book_ord").agg(F.count(F.lit(1)).alias("n"))


@query("name_spellings", """WITH RECURSIVE c(m, r) AS (VALUES ('o','0'), ('1','I'), ('1','l'), ('M','m'), ('o','O'), ('S','s'), ('s','S')),
choices AS (SELECT m AS ch, r FROM c UNION ALL SELECT DISTINCT m, m FROM c),
grow AS (SELECT s_suppkey, s_name, 0 AS i, '' AS alias FROM supplier UNION ALL
  SELECT s_suppkey, s_name, i + 1, alias || coalesce(r, s_name[i + 1]) FROM grow LEFT JOIN choices ON ch = s_name[i + 1]
  WHERE i < length(s_name))
SELECT s_name AS variant, alias FROM grow WHERE i = length(s_name) AND alias <> s_name""")
def name_spellings(spark, sf_dir):
    names = table(spark, sf_dir, "supplier", "'en' as lang", "0 as book_ord", "s_name as variant")
    return dims.name_aliases(names).select("variant", "alias")


def _class(codes) -> str:
    return "".join(f"\\x{{{c:X}}}" for c in codes)


@query("character_categories", f"""SELECT lang,
  CAST(sum(length(regexp_replace(text, '[^A-Za-zÄäÖöÜü]', '', 'g'))) AS BIGINT) AS letter,
  CAST(sum(length(regexp_replace(text, '[^{_class(fixed.WHITESPACE_CODES)}]', '', 'g'))) AS BIGINT) AS whitespace,
  CAST(sum(length(regexp_replace(text, '[^{_class(fixed.LINE_CODES)}]', '', 'g'))) AS BIGINT) AS line,
  CAST(sum(length(regexp_replace(text, '[^.]', '', 'g'))) AS BIGINT) AS fullstop,
  CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digit,
  CAST(sum(length(regexp_replace(text, '[A-Za-zÄäÖöÜü0-9.{_class(fixed.WHITESPACE_CODES)}{_class(fixed.LINE_CODES)}]', '', 'g'))) AS BIGINT) AS other
FROM documents GROUP BY lang""")
def character_categories(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "text").select("lang", tx.category_counts(F.col("text"), "de").alias("c"))
    names = ["letter", "whitespace", "line", "fullstop", "digit", "other"]
    return d.select("lang", "c.*").groupBy("lang").agg(*[F.sum(n).cast("long").alias(n) for n in names])


@query("normalized_text", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text,
  '[{_class(fixed.WHITESPACE_CODES)}{_class(fixed.LINE_CODES)}.]', '', 'g'), '[^A-Za-z0-9]', '*', 'g')) AS digest FROM documents""")
def normalized_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(tx.normalized(F.col("text"), "en")).alias("digest"))


@query("text_within_range", """SELECT doc_id, md5(repeat(' ', CAST(b AS INTEGER)) || substr(text, b + 1, e - b) || repeat(' ', CAST(length(text) - e AS INTEGER))) AS digest
FROM (SELECT *, least(doc_id % 50, length(text)) AS b, least(doc_id % 50 + doc_id % 300, length(text)) AS e FROM documents)""")
def text_within_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text", "cast(doc_id % 50 as int) as b", "cast(doc_id % 50 + doc_id % 300 as int) as e")
    return d.select("doc_id", F.md5(tx.blank_outside(F.col("text"), F.col("b"), F.col("e"))).alias("digest"))


@query("markup_round_trip", """WITH p AS (SELECT doc_id, text, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc
  FROM documents)
SELECT doc_id, md5('<p data-id="undefined">' || esc || '</p>') AS markup, md5(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS plain FROM p""")
def markup_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("m", tx.plain_to_markup(F.col("text")))
    return d.select("doc_id", F.md5("m").alias("markup"), F.md5(tx.markup_to_plain(F.col("m"))).alias("plain"))


@query("markup_to_plain", """WITH m AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '<p>' || t ELSE trim(regexp_replace(t, ' +', ' ', 'g')) || ' und ' || role_text END AS plain
FROM (SELECT conv_id, turn, t, 'a < b' AS role_text FROM m)""")
def markup_to_plain(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "replace(text, char(10), ' ') as t")
    m = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("<p>"), "t")).otherwise(F.concat(
        F.lit('<p data-id="begin">  '), "t", F.lit(' </p><p data-id="continue"> </p><p data-id="begin"><b>u<i>n</i>d</b> a &#60; b</p>')
    ))
    return d.select("conv_id", "turn", tx.markup_to_plain(m).alias("plain"))


@query("blank_and_trimmed", f"""SELECT conv_id, turn, regexp_replace(regexp_replace(s, '^[{_class(fixed.WHITESPACE_CODES)}]+', ''),
  '[{_class(fixed.WHITESPACE_CODES)}]+$', '') AS trimmed, NOT regexp_matches(s, '[^{_class(fixed.WHITESPACE_CODES)}]') AS blank
FROM (SELECT conv_id, turn, chr(8203) || CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END || chr(160) || ' ' AS s FROM conversations)""")
def blank_and_trimmed(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    s = F.concat(F.lit("​"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")), F.lit("  "))
    return d.select("conv_id", "turn", tx.trimmed(s).alias("trimmed"), tx.is_blank(s).alias("blank"))
