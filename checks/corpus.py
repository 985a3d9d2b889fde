"""Scripture documents, archives, metadata files and the verse store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from versewright import fixed
from versewright.functions import text as tx
from versewright.operators import extract
from versewright.session import shared_folder
from versewright.sources import archives, markup, metadata

from . import citing, references
from .base import books_cte, query, table, vers_cte

# A book per conversation: three turns a chapter, turns of the assistant open a paragraph of their own.
TURNS_SQL = f"""{books_cte()}, turns AS (SELECT conv_id, turn, role, regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') AS t,
  CAST(turn // 3 + 1 AS INTEGER) AS chapter, CAST(turn % 3 + 1 AS INTEGER) AS verse, conv_id % 66 + 1 AS book_ord,
  turn % 3 = 0 OR role = 'assistant' AS opens,
  coalesce(lead(turn % 3 = 0 OR role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn), true) AS closes FROM conversations)"""


def _verses_sql(space: str, name: str) -> str:
    return f"""WITH {TURNS_SQL}, v AS (SELECT conv_id, book_ord, chapter, verse, '<p data-id="' || CASE WHEN opens THEN 'begin' ELSE 'continue' END ||
  '"><i>Lord</i> &amp; ' || t || CASE WHEN closes THEN '' ELSE '{space}' END || '</p>' AS markup,
  CASE WHEN turn % 4 = 1 THEN 'Mk ' || turn || '.2' ELSE '' END AS refs, turn FROM turns
UNION ALL SELECT conv_id, book_ord, chapter, UNNEST([4, 5]), '', '', turn FROM turns WHERE verse = 3)
SELECT conv_id, CAST(book_ord AS INTEGER) AS book_ord, chapter, CAST(verse AS INTEGER) AS verse, markup, refs FROM v"""


def usfm_documents(spark, sf_dir):
    d = table(
        spark, sf_dir, "conversations", "conv_id", "turn", r"""
        case when turn % 3 = 0 then '\\c ' || (turn div 3 + 1) || '\n\\s1 Heading\n\\p\n' else '' end ||
        case when role = 'assistant' then '\\q1\n' else '' end ||
        '\\v ' || case when turn % 3 = 2 then '3-5' else string(turn % 3 + 1) end || ' \\nd Lord\\nd* & ' || text ||
        case when turn % 2 = 1 then '\\f + \\fr 1.1 \\ft A note\\f*' else '' end ||
        case when turn % 4 = 1 then '\\x - \\xo 1.1 \\xt Mk ' || turn || '.2\\x*' else '' end || '\n' as piece""",
    )
    head = r"""'\\id ' || code || ' Text\n\\usfm 3.0\n' || case when conv_id % 3 = 0 then '' else '\\h Head ' || conv_id || '\n\\toc1 Long ' || conv_id || '\n' end"""
    return _documents(d, head, "''", "usfm")


def usx_documents(spark, sf_dir):
    d = table(
        spark, sf_dir, "conversations", "conv_id", "turn", r"""
        case when turn % 3 = 0 then case when turn > 0 then '</para>' else '' end || '<chapter number="' || (turn div 3 + 1) ||
          '" style="c" sid="x"/><para style="s1">Heading</para><para style="p">' else '' end ||
        case when role = 'assistant' then '</para><para style="q1">' else '' end ||
        '<verse number="' || case when turn % 3 = 2 then '3-5' else string(turn % 3 + 1) end || '" style="v"/><char style="nd">Lord</char> &amp; ' ||
        regexp_replace(text, '[ \t\n\r]+', ' ') ||
        case when turn % 2 = 1 then '<note caller="+" style="f"><char style="fr">1.1 </char><char style="ft">A note</char></note>' else '' end ||
        case when turn % 4 = 1 then '<note caller="-" style="x"><char style="xo">1.1 </char><char style="xt">Mk ' || turn || '.2</char></note>' else '' end ||
        '<verse eid="x"/>' as piece""",
    )
    head = r"""'<?xml version="1.0"?><usx version="3.0"><book code="' || code || '" style="id">Text</book>' || case when conv_id % 3 = 0 then '' else
      '<para style="h">Head ' || conv_id || '</para><para style="toc1">Long ' || conv_id || '</para>' end"""
    return _documents(d, head, "'</para></usx>'", "usx")


def _documents(pieces, head: str, tail: str, fmt: str):
    codes = F.array(*[F.lit(c) for _, c in fixed.BOOKS])
    d = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("p"))
    d = d.withColumn("code", F.get(codes, (F.col("conv_id") % 66).cast("int")))
    body = F.array_join(F.col("p.piece"), "")
    return d.select(
        F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string"), F.lit(".zip")).alias("file"),
        F.col("conv_id").cast("int").alias("entry_idx"), F.concat(F.col("conv_id").cast("string"), F.lit(f".{fmt}")).alias("entry"),
        F.concat(F.expr(head), body, F.expr(tail)).alias("text"), F.lit(fmt).alias("format"),
    )


def _verse_rows(docs):
    v = markup.verse_rows(markup.documents(docs))
    return v.select(
        F.col("entry_idx").cast("long").alias("conv_id"), "book_ord", "chapter", "verse", "markup",
        F.array_join("cross_references", "|").alias("refs"),
    )


@query("usfm_verses", _verses_sql(" ", "usfm"))
def usfm_verses(spark, sf_dir):
    return _verse_rows(usfm_documents(spark, sf_dir))


@query("usx_verses", _verses_sql("", "usx"))
def usx_verses(spark, sf_dir):
    return _verse_rows(usx_documents(spark, sf_dir))


@query("book_header_names", f"""WITH {TURNS_SQL} SELECT DISTINCT conv_id, code, CASE WHEN conv_id % 3 = 0 THEN code ELSE 'Head ' || conv_id END AS short_name,
  CASE WHEN conv_id % 3 = 0 THEN code ELSE 'Head ' || conv_id END AS abbreviation,
  CASE WHEN conv_id % 3 = 0 THEN code ELSE 'Long ' || conv_id END AS long_name FROM turns JOIN books USING (book_ord)""")
def book_header_names(spark, sf_dir):
    d = markup.book_names(markup.documents(usfm_documents(spark, sf_dir)))
    return d.select(F.col("entry_idx").cast("long").alias("conv_id"), "code", "short_name", "abbreviation", "long_name")


@query("first_file_per_book", f"""WITH {TURNS_SQL}, f AS (SELECT conv_id % 20 AS file, conv_id % 10 AS book, min(conv_id) AS conv_id
  FROM conversations GROUP BY ALL)
SELECT 'c' || file || '.zip' AS file, conv_id, CAST(count(*) + 2 * count(*) FILTER (verse = 3) AS BIGINT) AS verses FROM f JOIN turns USING (conv_id) GROUP BY ALL""")
def first_file_per_book(spark, sf_dir):
    docs = markup.documents(usfm_documents(spark, sf_dir)).withColumn("book_ord", (F.col("entry_idx") % 10 + 1).cast("int"))
    v = markup.first_file_per_book(markup.verse_rows(docs))
    return v.groupBy("file", F.col("entry_idx").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("verses"))


@query("rejected_documents", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id || '.usfm: no book identification' WHEN 1 THEN page_id || '.usx: no XML'
  ELSE page_id || '.usx: no usx root element' END AS error FROM pages""")
def rejected_documents(spark, sf_dir):
    d = table(
        spark, sf_dir, "pages", "cast(page_id as int) as entry_idx", "'p.zip' as file",
        "case when page_id % 3 = 0 then page_id || '.usfm' else page_id || '.usx' end as entry",
        "case when page_id % 3 = 0 then 'usfm' else 'usx' end as format",
        r"case page_id % 3 when 0 then '\\p ' || html when 1 then '<usx><para>' || html else '<html><!--' || replace(html, '-', ' ') || '--></html>' end as text",
    )
    return markup.documents(d).select(F.col("entry_idx").cast("long").alias("page_id"), "error")


@query("marker_attributes", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS lemma,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS file, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS size FROM customer""")
def marker_attributes(spark, sf_dir):
    d = table(spark, sf_dir, "customer", "c_custkey", """case when c_custkey % 2 = 0 then ' ' || c_name || ' ' else
      'src="' || c_mktsegment || '" size = "' || c_name || '"' end as list""")
    a = markup.attributes(F.lit("w"), F.col("list"))
    return d.select("c_custkey", *[F.element_at(a, k).alias(k) for k in ("lemma", "file", "size")])


@query("metadata_settings", """SELECT c_custkey, 'Bible of ' || c_name AS name, c_mktsegment AS abbreviation, 'A & B' AS language,
  CASE WHEN c_custkey % 2 = 0 THEN '(c)' END AS copyright FROM customer WHERE c_custkey % 5 <> 0""")
def metadata_settings(spark, sf_dir):
    d = table(spark, sf_dir, "customer", "c_custkey", """'<ScriptureText><Language>A &amp; B</Language><Naming><Name>no</Name></Naming><Name> ' || c_mktsegment || ' </Name>' ||
      case when c_custkey % 2 = 0 then '<Copyright>(c)</Copyright>' else '' end || '<FullName>Bible of ' || c_name ||
      case when c_custkey % 5 = 0 then '' else '</FullName></ScriptureText>' end as text""")
    # Read once, not again below the filter on it.
    d = extract.computed_once(d, "i", metadata.paratext(F.col("text"))).where("i is not null")
    return d.select("c_custkey", "i.*")


@query("metadata_bundle", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Lokal ' ELSE '' END || c_name AS name, c_mktsegment AS abbreviation,
  'German' AS language, '(c) ' || c_name AS copyright FROM customer""")
def metadata_bundle(spark, sf_dir):
    d = table(spark, sf_dir, "customer", "c_custkey", """'<DBLMetadata><identification><name>' || c_name || '</name>' ||
      case when c_custkey % 2 = 0 then '<nameLocal>Lokal ' || c_name || '</nameLocal>' else '' end || '<abbreviation>' || c_mktsegment ||
      '</abbreviation></identification><language><iso>deu</iso><name>German</name></language><copyright><fullStatement><statementContent type="xhtml"><p>(c) ' ||
      c_name || '</p></statementContent></fullStatement></copyright></DBLMetadata>' as text""")
    return d.select("c_custkey", metadata.dbl(F.col("text")).alias("i")).select("c_custkey", "i.*")


_HTML = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("metadata_copyright_page", f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h,
  regexp_replace(regexp_extract(html, '(?s)<p(?:>|\\s[^>]*>)(.*?)</p>', 1), '(?s)<br.*$', '') AS p FROM pages)
SELECT page_id, 'p' || page_id AS abbreviation, 'Language ' || page_id % 7 AS language,
  nullif({_HTML.format("trim(regexp_replace(h, '<[^>]*>', '', 'g'))")}, '') AS name,
  nullif({_HTML.format("trim(regexp_replace(p, '<[^>]*>', '', 'g'))")}, '') AS copyright FROM p""")
def metadata_copyright_page(spark, sf_dir):
    contents = """'<div class="toc"> <a class="x" href="https://x.example/in/p' || page_id || '">T</a></div>'"""
    spoken = """'Language: <a href="l">Language ' || page_id % 7 || ' (own name)</a>'"""
    d = table(spark, sf_dir, "pages", "page_id", f"html || {contents} || {spoken} as html")
    return d.select("page_id", metadata.ebible(F.col("html")).alias("i")).select("page_id", "i.*")


ENTRIES_SQL = """entries AS (SELECT 'a' || (page_id % 20) AS file, page_id, repeat('d/', CAST(page_id // 20 % 3 AS INTEGER)) || CASE page_id % 6 WHEN 0 THEN 'Settings.XML'
  WHEN 1 THEN 'x.USFM' WHEN 2 THEN 'x.usx' WHEN 3 THEN 'y.sfm' WHEN 4 THEN 'settings.xml' ELSE 'read.me' END AS entry, page_id // 20 % 3 AS depth FROM pages)"""


def _entries(spark, sf_dir):
    return table(
        spark, sf_dir, "pages", "'a' || (page_id % 20) as file", "cast(page_id as int) as entry_idx", "page_id",
        """repeat('d/', cast(page_id div 20 % 3 as int)) || case page_id % 6 when 0 then 'Settings.XML' when 1 then 'x.USFM' when 2 then 'x.usx'
           when 3 then 'y.sfm' when 4 then 'settings.xml' else 'read.me' end as entry""",
        "case page_id % 7 when 0 then concat(unhex('FF'), cast(html as binary)) when 1 then concat(unhex('EFBBBF'), cast(html as binary)) else cast(html as binary) end as content",
    )


@query("archive_entry_search", f"""WITH {ENTRIES_SQL} SELECT file, first(page_id ORDER BY depth, page_id) AS page_id FROM entries
WHERE page_id % 6 IN (0, 4) GROUP BY file""")
def archive_entry_search(spark, sf_dir):
    return archives.find_entry(_entries(spark, sf_dir), "settings.xml").select("file", "page_id")


@query("archive_routing", f"""WITH {ENTRIES_SQL}, f AS (SELECT *, CASE page_id % 6 WHEN 1 THEN 'usfm' WHEN 3 THEN 'usfm' WHEN 2 THEN 'usx' END AS format FROM entries),
c AS (SELECT file, min(format) AS format FROM f GROUP BY file)
SELECT file, page_id, format FROM f JOIN c USING (file, format)""")
def archive_routing(spark, sf_dir):
    return archives.routed(_entries(spark, sf_dir)).select("file", "page_id", "format")


@query("archive_decoding", """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN md5(html) END AS digest FROM pages""")
def archive_decoding(spark, sf_dir):
    return archives.decoded(_entries(spark, sf_dir)).select("page_id", F.md5("text").alias("digest"))


@query("changed_archives", """SELECT 'f' || o_orderkey AS file, 'read' AS action FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)
UNION ALL SELECT 'f' || o_orderkey, 'drop' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0""")
def changed_archives(spark, sf_dir):
    files = table(spark, sf_dir, "orders", "'f' || o_orderkey as file", "o_custkey as size", "o_orderkey as modified", "o_orderkey as k").where("k % 3 <> 0")
    kept = table(spark, sf_dir, "orders", "'f' || o_orderkey as file", "o_orderkey as k",
                 f"'{archives.STORE_VERSION}|' || (o_custkey + case when o_orderkey % 5 = 0 then 1 else 0 end) || '|' || o_orderkey as stamp").where("k % 7 <> 0")
    todo = archives.changed(files.drop("k"), kept).select("file", F.lit("read").alias("action"))
    return todo.unionByName(archives.vanished(files, kept).select("file", F.lit("drop").alias("action")))


@query("catalog_names", r"""WITH n AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') AS file, c_mktsegment || CASE c_custkey % 10
  WHEN 7 THEN ' (' || c_custkey % 40 || ')' WHEN 3 THEN ' (1) (' || c_custkey % 4 || ')' ELSE '' END AS name FROM customer),
f AS (SELECT list(file ORDER BY file) AS files, list_reduce(list([name] ORDER BY file), lambda s, n: list_append(s, CASE WHEN NOT list_contains(s, n[1]) THEN n[1] ELSE
  n[1] || ' (' || (1 + coalesce(list_max(list_transform(list_filter(s, lambda t: starts_with(t, n[1]) AND regexp_full_match(substr(t, length(n[1]) + 1), ' \((0|[1-9][0-9]*)\)')),
    lambda t: CAST(regexp_extract(substr(t, length(n[1]) + 1), '[0-9]+') AS BIGINT))), 0)) || ')' END)) AS names FROM n)
SELECT unnest(files) AS file, unnest(names) AS catalog_name FROM f""")
def catalog_names(spark, sf_dir):
    d = table(spark, sf_dir, "customer", "lpad(string(c_custkey), 9, '0') as file", """c_mktsegment || case c_custkey % 10 when 7 then ' (' || c_custkey % 40 || ')'
      when 3 then ' (1) (' || c_custkey % 4 || ')' else '' end as name""")
    return archives.named(d).select("file", "catalog_name")


@query("reader_output", f"""WITH {vers_cte('kjv')}, {references.OBSERVED}, {books_cte()}
SELECT scripture AS file, book_id, CAST(chapter AS INTEGER) AS chapter, CAST(last_verse AS INTEGER) AS last_verse FROM ends JOIN books USING (book_ord)""")
def reader_output(spark, sf_dir):
    v = references.observed(spark, sf_dir).withColumnRenamed("scripture", "file")
    names = v.select("file", "book_ord").distinct().withColumns({f: F.lit(f) for f in ("abbreviation", "short_name", "long_name")})
    ends = archives.from_reader_output(archives.reader_output(names, v)).where("error is null")
    return ends.select("file", "book_id", "chapter", "last_verse")


@query("stored_verses", f"""WITH {vers_cte('kjv')}, {citing.VERSES_SQL} SELECT scripture, count(*) AS n, count(*) FILTER (plain = '') AS empty FROM verses GROUP BY scripture""")
def stored_verses(spark, sf_dir):
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    archives.write_verses(citing.verses(spark, sf_dir), path)
    return archives.read_verses(spark, path).groupBy("scripture").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("markup") == "").alias("empty")
    )


@query("text_free_styles", """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS text_free FROM part""")
def text_free_styles(spark, sf_dir):
    d = table(spark, sf_dir, "part", "p_partkey", """case p_partkey % 4 when 0 then 'i' || p_brand when 1 then 's' || (p_partkey % 10)
      when 2 then 'q' || (p_partkey % 10) else 's' || p_partkey || 'x' end as style""")
    return d.select("p_partkey", markup.is_text_free(F.col("style")).alias("text_free"))


@query("marker_numbers", """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS first, CAST(greatest(l_linenumber, l_suppkey) AS INTEGER) AS last FROM lineitem""")
def marker_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "' ' || l_linenumber || 'a-' || l_suppkey || 'b' as m")
    return d.select("l_orderkey", "l_linenumber", markup.marker_number(F.col("m")).alias("first"), markup.marker_last(F.col("m")).alias("last"))


@query("escaped_markup", """SELECT conv_id, turn, md5('<p data-id="begin">' || replace(replace(replace(text || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>') AS digest FROM conversations""")
def escaped_markup(spark, sf_dir):
    d = table(spark, sf_dir, "conversations", "conv_id", "turn", "text || ' <&>' as t")
    return d.select("conv_id", "turn", F.md5(tx.section(F.lit("begin"), tx.escaped(F.col("t")))).alias("digest"))


# An archive for every page: a file that reads, one of no known book, one that's no text, one of no reader, one without its
# root; half with project settings, a third with bundle metadata.
def _archives(spark, sf_dir):
    d = table(spark, sf_dir, "pages", "page_id", "html", "'f' || page_id || '.zip' as file")
    body = r"""case page_id % 5 when 0 then '\\id RUT\n\\c 1\n\\p\n\\v 1 ' || translate(html, '\\\n', '  ') when 1 then '\\id ZZZ\n\\c 1\n\\p\n\\v 1 x'
      when 3 then html else '<a>' || page_id || '</a>' end"""
    texts = d.selectExpr(
        "file", "0 as entry_idx", "case page_id % 5 when 0 then 'x/RUT.usfm' when 1 then 'ZZZ.usfm' when 2 then 'GEN.usfm' when 3 then 'a.txt' else 'b.usx' end as entry",
        f"case page_id % 5 when 2 then concat(unhex('FF'), cast(html as binary)) else cast({body} as binary) end as content")
    settings = d.where("page_id % 2 = 0").selectExpr("file", "1 as entry_idx", "'settings.xml' as entry",
        "cast('<ScriptureText><FullName>S' || page_id || '</FullName><Name>s</Name></ScriptureText>' as binary) as content")
    bundle = d.where("page_id % 3 = 0").selectExpr("file", "2 as entry_idx", "'metadata.xml' as entry",
        "cast('<DBLMetadata><identification><name>M' || page_id || '</name></identification></DBLMetadata>' as binary) as content")
    return texts.unionByName(settings).unionByName(bundle)


@query("archive_status", """SELECT 'f' || page_id || '.zip' AS file, CASE page_id % 5 WHEN 1 THEN 'no book of the app' WHEN 2 THEN 'GEN.usfm: no UTF-8 text'
  WHEN 3 THEN 'no reader' WHEN 4 THEN 'b.usx: no usx root element' END AS error FROM pages""")
def archive_status(spark, sf_dir):
    return archives.read_archives(_archives(spark, sf_dir))["status"].select("file", "error")


@query("archive_info", """SELECT 'f' || page_id || '.zip' AS file, CASE WHEN page_id % 2 = 0 THEN 'S' || page_id WHEN page_id % 3 = 0 THEN 'M' || page_id
  ELSE 'f' || page_id END AS name, CASE WHEN page_id % 2 = 0 THEN 's' END AS abbreviation FROM pages WHERE page_id % 5 = 0""")
def archive_info(spark, sf_dir):
    return archives.read_archives(_archives(spark, sf_dir))["info"].select("file", "name", "abbreviation")
