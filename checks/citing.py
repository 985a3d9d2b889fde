"""Scriptures, verse text, citations and lookup URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewright import fixed
from versewright.functions import mask as masks
from versewright.functions import refs
from versewright.operators import cite, versify

from .base import RANGES_CTE, books_cte, chapters, flat, lit, query, table, vers_cte, verse_ranges

# Verses of three scriptures written by the orders; those a scripture has no order for are missing.
VERSES_SQL = """orders_of AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END AS scripture,
  CASE WHEN o_custkey % 4 >= 2 THEN o_orderkey // 2 ELSE o_orderkey END % 31102 + 1 AS ord, o_orderkey, o_orderpriority FROM orders),
verses AS (SELECT scripture, ord, CASE WHEN min(o_orderkey) % 10 = 3 THEN '' ELSE
  trim(first(o_orderpriority ORDER BY o_orderkey)) || ' & ' || min(o_orderkey) END AS plain FROM orders_of GROUP BY scripture, ord)"""


def verses(spark, sf_dir):
    d = table(
        spark, sf_dir, "orders", """case o_custkey % 4 when 0 then 'Alpha' when 1 then 'Beta' else 'Gamma' end as scripture""",
        """cast((case when o_custkey % 4 >= 2 then o_orderkey div 2 else o_orderkey end) % 31102 + 1 as int) as verse_ord""",
        "o_orderkey", "o_orderpriority",
    ).groupBy("scripture", "verse_ord").agg(
        F.min("o_orderkey").alias("k"), F.min_by("o_orderpriority", "o_orderkey").alias("p")
    ).withColumn("vers_name", F.lit("kjv"))
    d = versify.from_ordinals(d, chapters("kjv"))
    text = F.concat(F.lit('<p data-id="begin">  '), F.trim("p"), F.lit(" <i>&amp;</i> "), F.col("k").cast("string"), F.lit("</p>"))
    return cite.stored_by_chapter(d.select(
        "scripture", "book_ord", "chapter", "verse", F.when(F.col("k") % 10 == 3, "").otherwise(text).alias("markup"),
        F.array(F.concat(F.lit("Joh "), (F.col("k") % 21 + 1).cast("string"), F.lit(",1"))).alias("cross_references"),
    ), int(spark.conf.get("spark.sql.shuffle.partitions")))


INFO_SQL = """infos(scripture, abbreviation, language, copyright) AS (SELECT DISTINCT s, left(s, 2), CASE WHEN s = 'Beta' THEN NULL ELSE 'de' END,
  CASE WHEN s = 'Alpha' THEN '(c) ' || s END FROM (SELECT scripture AS s FROM orders_of))"""


def scriptures(spark, sf_dir):
    s = verses(spark, sf_dir).select("scripture").distinct()
    return s.select(
        "scripture", F.left("scripture", F.lit(2)).alias("abbreviation"),
        F.when(F.col("scripture") != "Beta", "de").alias("language"),
        F.when(F.col("scripture") == "Alpha", F.concat(F.lit("(c) "), "scripture")).alias("copyright"),
    )


BOOKS_SQL = f"""{books_cte()}, sbooks AS (SELECT scripture, CAST(book_ord AS INTEGER) AS book_ord,
  CASE WHEN book_ord % 5 = 0 THEN NULL ELSE code END AS abbreviation, CASE WHEN book_ord % 3 = 0 THEN NULL ELSE upper(book_id) END AS short_name,
  CASE WHEN book_ord % 15 = 0 THEN NULL ELSE 'Book of ' || book_id END AS long_name
  FROM (SELECT DISTINCT scripture, book_ord FROM verses JOIN verse ON verse_ord = ord) JOIN books USING (book_ord))"""


def scripture_books(spark, sf_dir):
    d = verses(spark, sf_dir).select("scripture", "book_ord").distinct()
    b, book = F.col("book_ord"), refs.book_id(F.col("book_ord"))
    code = F.element_at(F.array(*[F.lit(c) for _, c in fixed.BOOKS]), b)
    return d.select(
        "scripture", "book_ord", F.when(b % 5 != 0, code).alias("abbreviation"),
        F.when(b % 3 != 0, F.upper(book)).alias("short_name"),
        F.when(b % 15 != 0, F.concat(F.lit("Book of "), book)).alias("long_name"),
    )


WANTED_SQL = "CASE l_orderkey % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END"


def wanted(spark, sf_dir):
    pick = F.when(F.col("l_orderkey") % 4 == 0, "Alpha").when(F.col("l_orderkey") % 4 == 1, "Beta").otherwise("Gamma")
    return verse_ranges(spark, sf_dir).withColumn("scripture", pick)


@query("range_contents", f"""WITH {vers_cte('kjv')}, {RANGES_CTE}, {VERSES_SQL},
w AS (SELECT DISTINCT {WANTED_SQL} AS scripture, fo, t_o FROM ranges),
j AS (SELECT w.scripture, fo, t_o, verse_ord, verse, plain FROM w JOIN verse ON verse_ord BETWEEN fo AND t_o
  LEFT JOIN verses v ON v.scripture = w.scripture AND v.ord = verse_ord)
SELECT scripture, CAST(fo AS INTEGER) AS from_ord, CAST(t_o AS INTEGER) AS to_ord,
  CASE WHEN bool_and(plain IS NOT NULL) THEN coalesce(string_agg(plain, ' ' ORDER BY verse_ord) FILTER (plain <> ''), '') END AS content,
  CASE WHEN bool_and(plain IS NOT NULL) THEN coalesce(string_agg(verse || ' ' || plain, ' ' ORDER BY verse_ord) FILTER (plain <> ''), '') END AS content_numbered
FROM j GROUP BY scripture, fo, t_o""")
def range_contents(spark, sf_dir):
    d = wanted(spark, sf_dir)
    kjv = chapters("kjv")
    d = versify.with_bounds(cite.contents(d, verses(spark, sf_dir), kjv), kjv)
    return d.select("scripture", "from_ord", "to_ord", "content", "content_numbered")


def _citations_sql(mask_sql: str, needs: bool) -> str:
    content = "c.content IS NOT NULL AND" if needs else ""
    return f"""WITH {vers_cte('kjv')}, {RANGES_CTE}, {VERSES_SQL}, {INFO_SQL}, {BOOKS_SQL},
w AS (SELECT l_orderkey, l_linenumber, {WANTED_SQL} AS scripture, fo, t_o, fb, fc, fv, tb, tc, tv FROM ranges),
j AS (SELECT w.scripture, fo, t_o, verse_ord, verse, plain FROM (SELECT DISTINCT scripture, fo, t_o FROM w)
  w JOIN verse ON verse_ord BETWEEN fo AND t_o LEFT JOIN verses v ON v.scripture = w.scripture AND v.ord = verse_ord),
c AS (SELECT scripture, fo, t_o, CASE WHEN bool_and(plain IS NOT NULL) THEN
  coalesce(string_agg(plain, ' ' ORDER BY verse_ord) FILTER (plain <> ''), '') END AS content FROM j GROUP BY ALL),
x AS (SELECT l_orderkey, l_linenumber, content, coalesce(a.short_name, '') AS book, coalesce(b.short_name, '') AS book_e, fc, fv, tc, tv,
  fb <> tb AS ob, fb <> tb OR fc <> tc AS oc, fo <> t_o AS ov, w.scripture, coalesce(i.abbreviation, '') AS abbr, coalesce(i.copyright, '') AS cr
  FROM w JOIN c USING (scripture, fo, t_o) LEFT JOIN infos i USING (scripture)
  LEFT JOIN sbooks a ON a.scripture = w.scripture AND a.book_ord = fb LEFT JOIN sbooks b ON b.scripture = w.scripture AND b.book_ord = tb)
SELECT l_orderkey, l_linenumber, CASE WHEN {content.replace('c.content', 'content')} true THEN nullif({mask_sql}, '') END AS citation FROM x"""


GERMAN_SQL = """'"' || content || '" (' || CASE WHEN book <> '' THEN book || chr(160) ELSE '' END || fc || ', ' || fv ||
  CASE WHEN ov THEN chr(160) || '- ' || CASE WHEN ob AND book_e <> '' THEN book_e || ' ' ELSE '' END ||
    CASE WHEN oc THEN tc || ',' ELSE '' END || tv ELSE '' END || CASE WHEN abbr <> '' THEN ' ' || abbr ELSE '' END || ')'"""


@query("citations_with_text", _citations_sql(GERMAN_SQL, True))
def citations_with_text(spark, sf_dir):
    d = wanted(spark, sf_dir)
    d = cite.citations(
        d, fixed.DEFAULT_MASKS["german"], scriptures(spark, sf_dir), scripture_books(spark, sf_dir), verses(spark, sf_dir),
        chapters("kjv"),
    )
    return d.select("l_orderkey", "l_linenumber", "citation")


SHORT_MASK = "{[book] }[#chapter_begin]{:[#verse_end]} [x] {<[copyright]>{y}}[tab]{z}"
SHORT_SQL = """CASE WHEN book <> '' THEN book || ' ' ELSE '' END || fc || CASE WHEN ov THEN ':' || tv ELSE '' END || ' [x] ' ||
  CASE WHEN cr <> '' THEN '<' || cr || '>{y}' ELSE '' END || chr(9) || '{z}'"""


@query("citations_without_text", _citations_sql(SHORT_SQL, False))
def citations_without_text(spark, sf_dir):
    assert not masks.needs_content(SHORT_MASK)
    d = wanted(spark, sf_dir)
    d = cite.citations(d, SHORT_MASK, scriptures(spark, sf_dir), scripture_books(spark, sf_dir), verses(spark, sf_dir), chapters("kjv"))
    return d.select("l_orderkey", "l_linenumber", "citation")


SOURCES_SQL = """files AS (SELECT DISTINCT 'S' || (c_custkey % 7) AS scripture FROM customer),
scripts AS (SELECT DISTINCT 'S' || (s_suppkey % 10) AS scripture FROM supplier),
asked AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'S' || (o_orderkey % 12) END AS scripture FROM orders)"""


def _sources(spark, sf_dir):
    files = table(spark, sf_dir, "customer", "'S' || (c_custkey % 7) as scripture").distinct()
    scripts = table(spark, sf_dir, "supplier", "'S' || (s_suppkey % 10) as scripture").distinct()
    return files, scripts


@query("scripture_catalog", f"""WITH {SOURCES_SQL} SELECT scripture, 'file' AS source FROM files
UNION ALL SELECT scripture, 'script' FROM scripts WHERE scripture NOT IN (SELECT scripture FROM files)""")
def scripture_catalog(spark, sf_dir):
    return cite.catalog(*_sources(spark, sf_dir))


@query("scripture_resolution", f"""WITH {SOURCES_SQL}, s AS (SELECT o_orderkey, coalesce(scripture, 'S3') AS selected FROM asked)
SELECT o_orderkey, selected, CASE WHEN selected IN (SELECT scripture FROM files) THEN 'file'
  WHEN selected IN (SELECT scripture FROM scripts) THEN 'script' END AS source,
  CASE WHEN selected NOT IN (SELECT scripture FROM files UNION SELECT scripture FROM scripts) THEN 'scripture not found' END AS error FROM s""")
def scripture_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "orders", "o_orderkey", "case when o_orderkey % 5 = 0 then null else 'S' || (o_orderkey % 12) end as scripture")
    return cite.resolve(d, cite.catalog(*_sources(spark, sf_dir)), "S3").drop("scripture")


@query("passage_requests", f"""WITH {vers_cte('kjv')}, {VERSES_SQL}, r AS (SELECT o_orderkey, o_orderkey % 31102 + 1 AS ord,
  CASE o_orderkey % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Delta' WHEN 2 THEN 'Beta' ELSE 'Gamma' END AS selected FROM orders)
SELECT o_orderkey, selected, CASE WHEN selected = 'Delta' THEN 'scripture not found' WHEN plain IS NULL THEN 'verse not found' END AS error,
  CASE WHEN plain IS NULL THEN NULL WHEN plain = '' THEN '' ELSE '<p data-id="begin">  ' || replace(plain, '&', '<i>&amp;</i>') || '</p>' END AS markup
FROM r LEFT JOIN verses v ON v.scripture = selected AND v.ord = r.ord""")
def passage_requests(spark, sf_dir):
    d = table(
        spark, sf_dir, "orders", "o_orderkey", "'kjv' as vers_name", "cast(o_orderkey % 31102 + 1 as int) as verse_ord",
        "case o_orderkey % 5 when 0 then 'Alpha' when 1 then 'Delta' when 2 then 'Beta' when 3 then 'Gamma' end as scripture",
    )
    d = versify.from_ordinals(d, chapters("kjv"))
    v = verses(spark, sf_dir)
    d = cite.passages(d, scriptures(spark, sf_dir).withColumn("source", F.lit("file")), v, "Gamma")
    return d.select("o_orderkey", "selected", "error", "markup")


@query("reading_view", f"""WITH {vers_cte('kjv')}, {VERSES_SQL}, {BOOKS_SQL},
r AS (SELECT o_orderkey, o_orderkey * 5 % 31102 + 1 AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'Alpha' ELSE 'Gamma' END AS scripture FROM orders),
x AS (SELECT r.*, verse_ord, v.book_ord, chapter, verse, plain, coalesce(nullif(short_name, ''), nullif(abbreviation, ''), nullif(long_name, ''), book_id) AS book_name
  FROM r JOIN verse v ON verse_ord BETWEEN r.ord - 2 AND r.ord + 2 LEFT JOIN verses t ON t.scripture = r.scripture AND t.ord = verse_ord
  LEFT JOIN sbooks s ON s.scripture = r.scripture AND s.book_ord = v.book_ord JOIN books b ON b.book_ord = v.book_ord)
SELECT o_orderkey, CAST(verse_ord - greatest(ord - 2, 1) AS INTEGER) AS "row", book_name, verse = 1 AS chapter_header,
  CASE WHEN plain IS NULL THEN NULL WHEN plain = '' THEN '' ELSE '<p data-id="begin">  ' || replace(plain, '&', '<i>&amp;</i>') || '</p>' END AS markup FROM x""")
def reading_view(spark, sf_dir):
    d = table(
        spark, sf_dir, "orders", "o_orderkey", "'kjv' as vers_name", "cast(o_orderkey * 5 % 31102 + 1 as int) as ord",
        "case when o_orderkey % 2 = 0 then 'Alpha' else 'Gamma' end as scripture",
    )
    kjv = chapters("kjv")
    d = versify.from_ordinals(d.withColumnRenamed("ord", "verse_ord"), kjv).drop("verse_ord")
    d = versify.context_window(d, kjv, 2).drop("book_ord", "chapter", "verse")
    d = cite.reading_rows(d, verses(spark, sf_dir), scripture_books(spark, sf_dir))
    return d.select("o_orderkey", "row", "book_name", "chapter_header", "markup")


@query("cross_reference_edges", f"""WITH {vers_cte('kjv')}, {VERSES_SQL}, k AS (SELECT scripture, ord, min(o_orderkey) AS k FROM orders_of GROUP BY ALL)
SELECT scripture, verse.book_ord AS src_book, CAST(verse.chapter AS INTEGER) AS src_chapter, CAST(verse.verse AS INTEGER) AS src_verse,
  43 AS fb, CAST(k % 21 + 1 AS INTEGER) AS fc, 1 AS fv, 43 AS tb, CAST(k % 21 + 1 AS INTEGER) AS tc, 1 AS tv
FROM k JOIN verse ON verse_ord = ord""")
def cross_reference_edges(spark, sf_dir):
    return flat(cite.cross_reference_edges(verses(spark, sf_dir), chapters("kjv"), "de", "kjv"), "range")


@query("scripture_information", f"""WITH {VERSES_SQL}, {INFO_SQL} SELECT o_orderkey, coalesce(abbreviation, '') AS scripture_abbr,
  coalesce(language, '') AS language, coalesce(copyright, '') AS copyright FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Alpha'
  WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' ELSE 'Delta' END AS scripture FROM orders) LEFT JOIN infos USING (scripture)""")
def scripture_information(spark, sf_dir):
    d = table(spark, sf_dir, "orders", "o_orderkey", """case o_orderkey % 4 when 0 then 'Alpha' when 1 then 'Beta' when 2 then 'Gamma' else 'Delta' end as scripture""")
    return cite.with_information(d, scriptures(spark, sf_dir)).drop("scripture")


TRANSLATIONS = ["Elberfelder 1905", "Lutherbibel", "King James Version", "XXX", "New International Version", "NGÜ",
                "Neue evangelistische Übersetzung", "Schlachter 2000"]


def _chosen_sql() -> str:
    rows = ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(TRANSLATIONS))
    return f"""listed(i, name) AS (VALUES {rows}), chosen AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'german' WHEN o_custkey % 3 = 1 THEN 'english'
  ELSE 'french' END AS language, CASE WHEN o_orderkey % 9 = 8 THEN []::VARCHAR[] ELSE [a.name, b.name] END AS picked FROM orders
  JOIN listed a ON a.i = o_orderkey % 8 JOIN listed b ON b.i = o_orderkey // 3 % 8)"""


def _chosen(spark, sf_dir):
    names = F.array(*map(F.lit, TRANSLATIONS))
    d = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", """case o_custkey % 3 when 0 then 'german' when 1 then 'english' else 'french' end as language""")
    pick = lambda k: F.get(names, k.cast("int"))
    both = F.array(pick(F.col("o_orderkey") % 8), pick(F.floor(F.col("o_orderkey") / 3) % 8))
    return d.withColumn("picked", F.when(F.col("o_orderkey") % 9 == 8, F.array().cast("array<string>")).otherwise(both))


def _offered(site: str) -> str:
    names = fixed.BIBLE_COM if site == "bible_com" else fixed.BIBLESERVER
    return "[" + ", ".join(lit(r[0]) for r in names) + "]"


def _translations_sql(site: str) -> str:
    defaults = " ".join(
        f"WHEN language = {lit(l)} THEN [{', '.join(map(lit, n))}]" for l, n in fixed.LOOKUP_DEFAULTS[site].items()
    )
    return f"""CASE WHEN len(list_filter(picked, lambda t: list_contains({_offered(site)}, t))) > 0 THEN
  list_filter(picked, lambda t: list_contains({_offered(site)}, t)) {defaults} ELSE []::VARCHAR[] END"""


@query("chosen_translations", f"""WITH {_chosen_sql()} SELECT o_orderkey, array_to_string({_translations_sql('bible_com')}, '|') AS bible_com,
  array_to_string({_translations_sql('bibleserver')}, '|') AS bibleserver FROM chosen""")
def chosen_translations(spark, sf_dir):
    d = _chosen(spark, sf_dir)
    shown = lambda s: F.array_join(cite.choose_translations(F.col("picked"), F.col("language"), s), "|")
    return d.select("o_orderkey", shown("bible_com").alias("bible_com"), shown("bibleserver").alias("bibleserver"))


def _urls_sql(site: str) -> str:
    if site == "bible_com":
        rows = ", ".join(f"({lit(n)}, {v}, {lit(a)})" for n, v, a in fixed.BIBLE_COM)
        names = "(SELECT book_ord AS b, code AS url_name FROM books)"
        url = """'https://www.bible.com/bible/' || (SELECT version FROM tr WHERE name = t[1]) || '/' || url_name || '.' || chapter || '.' || vv || '.' ||
  (SELECT abbr FROM tr WHERE name = t[1])"""
    else:
        rows = ", ".join(f"({lit(n)}, 0, {lit(a)})" for n, a in fixed.BIBLESERVER)
        names = "(VALUES " + ", ".join(f"({i}, {lit(fixed.bibleserver_book(i))})" for i in range(1, 67)) + ") n(b, url_name)"
        abbr = "CASE x " + " ".join(f"WHEN {lit(n)} THEN {lit(a)}" for n, a in fixed.BIBLESERVER) + " END"
        url = f"""'https://www.bibleserver.com/' || array_to_string(list_transform(t, lambda x: url_encode({abbr})), '.') || '/' ||
  url_encode(url_name) || chapter || '%2C' || vv"""
    return f"""WITH {vers_cte('kjv')}, {RANGES_CTE}, {books_cte()}, {_chosen_sql()}, tr(name, version, abbr) AS (VALUES {rows}),
g AS (SELECT l_orderkey, l_linenumber, fb, fi, fv, CASE WHEN fb = tb THEN ti ELSE fi END AS ti, CASE WHEN fb = tb THEN tv ELSE fv END AS tv FROM ranges),
p AS (SELECT l_orderkey, l_linenumber, book_ord, chapter, CASE WHEN chapter_idx = fi THEN fv ELSE 1 END AS a,
  CASE WHEN chapter_idx = ti THEN tv ELSE last_verse END AS z FROM g JOIN vers ON chapter_idx BETWEEN fi AND ti),
q AS (SELECT p.*, CASE WHEN z > a THEN a || '-' || z ELSE a::VARCHAR END AS vv,
  list_filter(picked, lambda t: list_contains({_offered(site)}, t)) AS t FROM p JOIN chosen ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, {url} AS url FROM q JOIN {names} ON b = book_ord WHERE len(t) > 0"""


def _urls(spark, sf_dir, site):
    picked = _chosen(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("picked").alias("translations"))
    d = verse_ranges(spark, sf_dir).join(picked, "l_orderkey")
    return cite.lookup_urls(d, site, chapters("kjv")).select("l_orderkey", "l_linenumber", "url")


@query("lookup_urls_bible_com", _urls_sql("bible_com"))
def lookup_urls_bible_com(spark, sf_dir):
    return _urls(spark, sf_dir, "bible_com")


@query("lookup_urls_bibleserver", _urls_sql("bibleserver"))
def lookup_urls_bibleserver(spark, sf_dir):
    return _urls(spark, sf_dir, "bibleserver")


@query("web_urls", """SELECT page_id, page_id % 5 NOT IN (1, 2, 3) AS web FROM pages""")
def web_urls(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", """case page_id % 5 when 1 then replace(replace(url, 'https:', 'ftp:'), 'http:', 'file:')
      when 2 then 'see ' || url when 3 then 'https:' when 4 then upper(left(url, 4)) || substr(url, 5) else url end as url""")
    return d.select("page_id", cite.is_web_url(F.col("url")).alias("web"))
