"""References, ranges and versifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewright import dims, fixed
from versewright.functions import refs
from versewright.operators import versify

from .base import ORD, RANGES_CTE, books_cte, chapter_table, chapters, flat, query, table, vers_cte, verse_ranges, verse_refs

LOOSE = ["l_orderkey", "l_linenumber", "case when l_linenumber % 2 = 0 then 'kjv' else 'esv' end as vers_name",
         "cast(l_partkey % 68 as int) as book_ord", "cast(l_suppkey % 60 as int) as chapter",
         "cast(l_quantity as int) - 2 as verse"]
LOOSE_SQL = """loose AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'kjv' ELSE 'esv' END AS vers_name,
  CAST(l_partkey % 68 AS INTEGER) AS book_ord, CAST(l_suppkey % 60 AS INTEGER) AS chapter,
  CAST(l_quantity AS INTEGER) - 2 AS verse FROM lineitem)"""


@query("reference_validity", f"""WITH {vers_cte()}, {LOOSE_SQL}
SELECT l_orderkey, l_linenumber, vers_name, book_ord, chapter, verse,
  coalesce(verse BETWEEN 1 AND last_verse, false) AS valid
FROM loose LEFT JOIN vers USING (vers_name, book_ord, chapter)""")
def reference_validity(spark, sf_dir):
    return versify.with_validity(table(spark, sf_dir, "lineitem", *LOOSE), chapters())


@query("reference_filter_valid", f"""WITH {vers_cte()}, {LOOSE_SQL}
SELECT book_ord, count(*) AS n, CAST(sum(verse) AS BIGINT) AS verses FROM loose JOIN vers USING (vers_name, book_ord, chapter)
WHERE verse BETWEEN 1 AND last_verse GROUP BY book_ord""")
def reference_filter_valid(spark, sf_dir):
    return versify.valid_only(table(spark, sf_dir, "lineitem", *LOOSE), chapters()).groupBy("book_ord").agg(
        F.count(F.lit(1)).alias("n"), F.sum("verse").alias("verses")
    )


@query("reference_clamp", f"""WITH {vers_cte()}, {LOOSE_SQL},
counts AS (SELECT vers_name, book_ord, max(chapter) AS n FROM vers GROUP BY ALL),
c AS (SELECT l.l_orderkey, l.l_linenumber, l.vers_name, least(greatest(l.book_ord, 1), 66) AS book_ord, n,
  least(greatest(l.chapter, 1), n) AS chapter, l.verse AS v
  FROM loose l JOIN counts k ON k.vers_name = l.vers_name AND k.book_ord = least(greatest(l.book_ord, 1), 66))
SELECT l_orderkey, l_linenumber, vers_name, CAST(book_ord AS INTEGER) AS book_ord, CAST(chapter AS INTEGER) AS chapter,
  CAST(least(greatest(v, 1), last_verse) AS INTEGER) AS verse FROM c JOIN vers USING (vers_name, book_ord, chapter)""")
def reference_clamp(spark, sf_dir):
    return versify.clamp(table(spark, sf_dir, "lineitem", *LOOSE), chapters())


@query("chapter_verse_count", f"""WITH {vers_cte()}, {LOOSE_SQL}
SELECT vers_name, book_ord, CAST(coalesce(last_verse, 0) AS INTEGER) AS verse_count, count(*) AS n
FROM loose LEFT JOIN vers USING (vers_name, book_ord, chapter) GROUP BY ALL""")
def chapter_verse_count(spark, sf_dir):
    d = versify.verse_count(table(spark, sf_dir, "lineitem", *LOOSE), chapters())
    return d.groupBy("vers_name", "book_ord", "verse_count").agg(F.count(F.lit(1)).alias("n"))


PAIR = ["l_orderkey", "l_linenumber", "cast(l_partkey % 66 + 1 as int) as b1", "cast(l_suppkey % 9 as int) as c1",
        "cast(l_quantity as int) as v1", "cast(l_suppkey % 66 + 1 as int) as b2", "cast(l_partkey % 9 as int) as c2",
        "l_linenumber as v2"]
PAIR_SQL = """pair AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 66 + 1 AS INTEGER) AS b1,
  CAST(l_suppkey % 9 AS INTEGER) AS c1, CAST(l_quantity AS INTEGER) AS v1, CAST(l_suppkey % 66 + 1 AS INTEGER) AS b2,
  CAST(l_partkey % 9 AS INTEGER) AS c2, l_linenumber AS v2 FROM lineitem)"""


@query("range_order_and_format", f"""WITH {books_cte()}, {PAIR_SQL},
s AS (SELECT *, (b1, c1, v1) <= (b2, c2, v2) AS up FROM pair)
SELECT l_orderkey, l_linenumber, (b1, c1, v1) < (b2, c2, v2) AS earlier,
  x.book_id || ' ' || CASE WHEN up THEN c1 ELSE c2 END || ', ' || CASE WHEN up THEN v1 ELSE v2 END || ' - ' ||
  y.book_id || ' ' || CASE WHEN up THEN c2 ELSE c1 END || ', ' || CASE WHEN up THEN v2 ELSE v1 END AS shown
FROM s JOIN books x ON x.book_ord = CASE WHEN up THEN b1 ELSE b2 END
JOIN books y ON y.book_ord = CASE WHEN up THEN b2 ELSE b1 END""")
def range_order_and_format(spark, sf_dir):
    a, b = refs.ref("b1", "c1", "v1"), refs.ref("b2", "c2", "v2")
    d = table(spark, sf_dir, "lineitem", *PAIR)
    return d.select("l_orderkey", "l_linenumber", (a < b).alias("earlier"), refs.format_range(refs.ref_range(a, b)).alias("shown"))


@query("identifier_parsing", f"""WITH {books_cte()}, r AS (SELECT o_orderkey, o_orderkey % 70 + 1 AS k,
  CASE WHEN o_orderkey % 11 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey * 400000 - 800000 AS VARCHAR) END AS number_text
  FROM orders)
SELECT o_orderkey, CAST(book_ord AS INTEGER) AS book_ord,
  CASE WHEN try_cast(number_text AS BIGINT) BETWEEN 1 AND 4294967295 THEN try_cast(number_text AS BIGINT) END AS number
FROM r LEFT JOIN books ON book_ord = k""")
def identifier_parsing(spark, sf_dir):
    d = table(spark, sf_dir, "orders", "o_orderkey", "cast(o_orderkey % 70 as int) as k", NUMBER_TEXT).withColumn("book_id", identifier(F.col("k")))
    return d.select("o_orderkey", refs.book_ord(F.col("book_id")).alias("book_ord"), refs.number(F.col("number_text")).alias("number"))


NUMBER_TEXT = "case when o_orderkey % 11 = 0 then 'x' || o_orderkey else cast(o_orderkey * 400000 - 800000 as string) end as number_text"


def identifier(k):
    return F.coalesce(F.get(F.array(*[F.lit(b) for b, _ in fixed.BOOKS]), k), F.lit("unknown"))


@query("parsed_references", f"""WITH {vers_cte('esv')}, r AS (SELECT o_orderkey, o_orderkey % 70 + 1 AS b,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 40 END AS c, o_orderkey % 45 AS v FROM orders),
k AS (SELECT r.*, CASE WHEN b > 66 THEN 'unknown book' WHEN c IS NULL OR c < 1 OR v < 1 THEN 'no number'
  WHEN last_verse IS NULL OR v > last_verse THEN 'no such verse' END AS error FROM r LEFT JOIN vers ON book_ord = b AND chapter = c)
SELECT o_orderkey, CAST(CASE WHEN error IS NULL THEN b END AS INTEGER) AS book_ord, CAST(CASE WHEN error IS NULL THEN c END AS INTEGER) AS chapter,
  CAST(CASE WHEN error IS NULL THEN v END AS INTEGER) AS verse, error FROM k""")
def parsed_references(spark, sf_dir):
    """Texts of book, chapter and verse: the references that exist and the others with the reason."""
    d = table(spark, sf_dir, "orders", "o_orderkey", "'esv' as vers_name", "cast(o_orderkey % 70 as int) as k",
              "case when o_orderkey % 11 = 0 then 'x' || o_custkey else cast(o_custkey % 40 as string) end as c", "cast(o_orderkey % 45 as string) as v")
    good, bad = versify.parsed(d.withColumn("b", identifier(F.col("k"))), chapters("esv"), "b", "c", "v")
    none = F.lit(None).cast("int")
    bad = bad.select("o_orderkey", *[none.alias(c) for c in ("book_ord", "chapter", "verse")], "error")
    return good.select("o_orderkey", "book_ord", "chapter", "verse", F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("request_range", f"""WITH {vers_cte('esv')}, r AS (SELECT o_orderkey, o_custkey % 66 + 1 AS b, o_orderkey % 25 AS c1,
  o_custkey % 30 AS v1, o_custkey % 25 AS c2, o_orderkey % 40 AS v2 FROM orders),
k AS (SELECT o_orderkey, b, c1, v1, c2, v2, x.last_verse IS NOT NULL AND v1 BETWEEN 1 AND x.last_verse AS ok1,
  y.last_verse IS NOT NULL AND v2 BETWEEN 1 AND y.last_verse AS ok2
  FROM r LEFT JOIN vers x ON x.book_ord = b AND x.chapter = c1 LEFT JOIN vers y ON y.book_ord = b AND y.chapter = c2)
SELECT o_orderkey, CAST(b AS INTEGER) AS fb,
  CAST(CASE WHEN ok2 AND (c2, v2) < (c1, v1) THEN c2 ELSE c1 END AS INTEGER) AS fc,
  CAST(CASE WHEN ok2 AND (c2, v2) < (c1, v1) THEN v2 ELSE v1 END AS INTEGER) AS fv, CAST(b AS INTEGER) AS tb,
  CAST(CASE WHEN ok2 AND (c2, v2) > (c1, v1) THEN c2 ELSE c1 END AS INTEGER) AS tc,
  CAST(CASE WHEN ok2 AND (c2, v2) > (c1, v1) THEN v2 ELSE v1 END AS INTEGER) AS tv FROM k WHERE ok1""")
def request_range(spark, sf_dir):
    d = table(
        spark, sf_dir, "orders", "o_orderkey", "'esv' as vers_name", "cast(o_custkey % 66 + 1 as int) as b",
        "cast(o_orderkey % 25 as int) as c1", "cast(o_custkey % 30 as int) as v1", "cast(o_custkey % 25 as int) as c2",
        "cast(o_orderkey % 40 as int) as v2",
    )
    esv = chapters("esv")
    for i in (1, 2):
        d = d.withColumns({"book_ord": F.col("b"), "chapter": F.col(f"c{i}"), "verse": F.col(f"v{i}")})
        d = versify.with_validity(d, esv)
        d = d.withColumn(f"r{i}", F.when(F.col("valid"), refs.ref("book_ord", "chapter", "verse")))
        d = d.drop("book_ord", "chapter", "verse", "valid")
    rng = refs.range_or_begin(F.col("r1"), F.col("r2"))
    return flat(d.select("o_orderkey", rng.alias("r")).where("r is not null"), "r")


@query("one_book_guard", f"""WITH {vers_cte('kjv')}, {RANGES_CTE}
SELECT fb AS book_ord, count(*) AS n, count(*) FILTER (fb <> tb) AS reduced,
  CAST(sum(CASE WHEN fb = tb THEN t_o - fo ELSE 0 END) AS BIGINT) AS width FROM ranges GROUP BY fb""")
def one_book_guard(spark, sf_dir):
    d = verse_ranges(spark, sf_dir).withColumn("guarded", refs.one_book(F.col("range")))
    d = versify.range_size(d, chapters("kjv"), "guarded")
    return d.groupBy(F.col("range.from.book_ord").alias("book_ord")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("range.from.book_ord") != F.col("range.to.book_ord")).alias("reduced"),
        F.sum(F.col("size") - 1).cast("long").alias("width"),
    )


@query("next_and_previous_verse", f"""WITH {vers_cte('kjv')},
walk AS (SELECT *, lead(struct_pack(b := book_ord, c := chapter, v := verse)) OVER (ORDER BY verse_ord) AS n,
  lag(struct_pack(b := book_ord, c := chapter, v := verse)) OVER (ORDER BY verse_ord) AS p FROM verse)
SELECT l_orderkey, l_linenumber, CAST(n.b AS INTEGER) AS nb, CAST(n.c AS INTEGER) AS nc, CAST(n.v AS INTEGER) AS nv,
  CAST(p.b AS INTEGER) AS pb, CAST(p.c AS INTEGER) AS pc, CAST(p.v AS INTEGER) AS pv
FROM lineitem JOIN walk ON verse_ord = {ORD}""")
def next_and_previous_verse(spark, sf_dir):
    d = versify.neighbours(verse_refs(spark, sf_dir).drop("verse_ord"), chapters("kjv"))
    cols = [F.col(f"{s}.{p}").alias(s[0] + p[0]) for s in ("next", "prev") for p in ("book_ord", "chapter", "verse")]
    return d.select("l_orderkey", "l_linenumber", *cols)


@query("range_size", f"""WITH {vers_cte('kjv')}, {RANGES_CTE}
SELECT l_orderkey, l_linenumber, CAST(t_o - fo + 1 AS INTEGER) AS size FROM ranges""")
def range_size(spark, sf_dir):
    d = versify.range_size(verse_ranges(spark, sf_dir), chapters("kjv"))
    return d.select("l_orderkey", "l_linenumber", "size")


@query("split_by_chapter", f"""WITH {vers_cte('kjv')}, {RANGES_CTE}
SELECT l_orderkey, l_linenumber, book_ord, chapter, CAST(CASE WHEN chapter_idx = fi THEN fv ELSE 1 END AS INTEGER) AS first,
  CAST(CASE WHEN chapter_idx = ti THEN tv ELSE last_verse END AS INTEGER) AS last
FROM ranges JOIN vers ON chapter_idx BETWEEN fi AND ti""")
def split_by_chapter(spark, sf_dir):
    d = versify.split_by_chapter(verse_ranges(spark, sf_dir), chapters("kjv"))
    return d.select(
        "l_orderkey", "l_linenumber", F.col("part.from.book_ord").alias("book_ord"),
        F.col("part.from.chapter").alias("chapter"), F.col("part.from.verse").alias("first"),
        F.col("part.to.verse").alias("last"),
    )


@query("range_verses", f"""WITH {vers_cte('kjv')}, {RANGES_CTE}
SELECT book_ord, chapter, count(*) AS n, CAST(sum(verse) AS BIGINT) AS verses
FROM ranges JOIN verse ON verse_ord BETWEEN fo AND t_o GROUP BY book_ord, chapter""")
def range_verses(spark, sf_dir):
    d = versify.expand(verse_ranges(spark, sf_dir), chapters("kjv"))
    return d.groupBy("book_ord", "chapter").agg(F.count(F.lit(1)).alias("n"), F.sum("verse").alias("verses"))


@query("context_window", f"""WITH {vers_cte('kjv')}, o AS (SELECT l_orderkey, l_linenumber, {ORD} AS ord FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(ord - greatest(ord - 10, 1) AS INTEGER) AS focus_row,
  CAST(count(*) AS BIGINT) AS row_count, CAST(sum(book_ord * 1000000 + chapter * 1000 + verse) AS BIGINT) AS checksum
FROM o JOIN verse ON verse_ord BETWEEN ord - 10 AND ord + 10 GROUP BY l_orderkey, l_linenumber, ord""")
def context_window(spark, sf_dir):
    d = versify.context_window(verse_refs(spark, sf_dir).withColumnRenamed("verse_ord", "ord"), chapters("kjv"))
    c = F.col("context")
    d = d.groupBy("l_orderkey", "l_linenumber", "ord", "focus_row").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(c["book_ord"] * 1000000 + c["chapter"] * 1000 + c["verse"]).cast("long").alias("checksum"),
    )
    # Line items of equal key carry equal references.
    return d.drop("ord")


@query("verse_pages", f"""WITH {vers_cte('kjv')}, o AS (SELECT o_orderkey, o_orderkey * 3 % 31102 + 1 AS a,
  least(o_orderkey * 3 % 31102 + 21, 31102) AS b FROM orders), sides AS (
SELECT o_orderkey, 'next' AS side, verse_ord, book_ord, chapter, verse FROM o JOIN verse ON verse_ord BETWEEN b + 1 AND b + 5
UNION ALL SELECT o_orderkey, 'prev', verse_ord, book_ord, chapter, verse FROM o JOIN verse ON verse_ord BETWEEN a - 5 AND a - 1)
SELECT o_orderkey, side, CAST(verse_ord AS INTEGER) AS verse_ord, book_ord, CAST(chapter AS INTEGER) AS chapter,
  CAST(verse AS INTEGER) AS verse FROM sides""")
def verse_pages(spark, sf_dir):
    d = table(
        spark, sf_dir, "orders", "o_orderkey", "'kjv' as vers_name", "cast(o_orderkey * 3 % 31102 + 1 as int) as first_ord",
        "cast(least(o_orderkey * 3 % 31102 + 21, 31102) as int) as last_ord",
    )
    kjv = chapters("kjv")
    both = versify.page(d, kjv, 5).withColumn("side", F.lit("next")).unionByName(
        versify.page(d, kjv, 5, forward=False).withColumn("side", F.lit("prev"))
    )
    return both.select("o_orderkey", "side", "verse_ord", "book_ord", "chapter", "verse")


# Scriptures with the verses their suppliers' line items point at; s2 has the New Testament only, one only 3 John.
OBSERVED = f"""every AS (SELECT 's' || (l_suppkey % 4) AS scripture, book_ord, chapter, verse FROM lineitem JOIN verse ON
  verse_ord = {ORD}), obs AS (SELECT * FROM every WHERE scripture <> 's2' OR book_ord > 39
  UNION ALL SELECT 'third john', book_ord, chapter, verse FROM every WHERE book_ord = 64),
ends AS (SELECT scripture, book_ord, chapter, max(verse) AS last_verse FROM obs GROUP BY ALL)"""


def observed(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem", "'s' || (l_suppkey % 4) as scripture", f"cast({ORD} as int) as verse_ord", "'kjv' as vers_name")
    d = versify.from_ordinals(d, chapters("kjv")).select("scripture", "book_ord", "chapter", "verse")
    john = d.where("book_ord = 64").withColumn("scripture", F.lit("third john"))
    return d.where("scripture <> 's2' or book_ord > 39").unionByName(john)


@query("observed_chapter_ends", f"""WITH {vers_cte('kjv')}, {OBSERVED}
SELECT scripture, book_ord, CAST(chapter AS INTEGER) AS chapter, CAST(last_verse AS INTEGER) AS last_verse FROM ends""")
def observed_chapter_ends(spark, sf_dir):
    return versify.chapter_ends(observed(spark, sf_dir))


CLOSEST = """hits AS (SELECT scripture, vers_name, count(*) AS n FROM ends JOIN vers USING (book_ord, chapter, last_verse)
  GROUP BY ALL),
closest AS (SELECT scripture, coalesce(first(vers_name ORDER BY n DESC, vers_name), 'esv') AS closest FROM
  (SELECT DISTINCT scripture FROM ends) LEFT JOIN hits USING (scripture) GROUP BY scripture)"""
OBSERVED_BOTH = OBSERVED.replace(f"verse_ord = {ORD}", f"vers_name = 'kjv' AND verse_ord = {ORD}")


@query("closest_versification", f"""WITH {vers_cte()}, {OBSERVED_BOTH}, {CLOSEST} SELECT * FROM closest""")
def closest_versification(spark, sf_dir):
    return versify.closest_default(versify.chapter_ends(observed(spark, sf_dir)), chapter_table(spark))


@query("lacking_books", f"""WITH {vers_cte('kjv')}, {OBSERVED}
SELECT scripture, CAST(b AS INTEGER) AS book_ord FROM (SELECT DISTINCT scripture FROM ends), range(1, 67) r(b)
WHERE (scripture, b) NOT IN (SELECT scripture, book_ord FROM ends)""")
def lacking_books(spark, sf_dir):
    return versify.lacking_books(versify.chapter_ends(observed(spark, sf_dir)), dims.books(spark))


DERIVED = f"""{OBSERVED_BOTH}, {CLOSEST}, filled AS (SELECT scripture, book_ord, chapter, last_verse FROM ends UNION ALL
  SELECT scripture, v.book_ord, v.chapter, v.last_verse FROM closest JOIN vers v ON v.vers_name = closest
  WHERE (scripture, v.book_ord) NOT IN (SELECT scripture, book_ord FROM ends))"""


@query("derived_versification", f"""WITH {vers_cte()}, {DERIVED}
SELECT scripture AS vers_name, book_ord, CAST(chapter AS INTEGER) AS chapter, CAST(last_verse AS INTEGER) AS last_verse,
  CAST(row_number() OVER (PARTITION BY scripture ORDER BY book_ord, chapter) AS INTEGER) AS chapter_idx,
  CAST(sum(last_verse) OVER (PARTITION BY scripture ORDER BY book_ord, chapter) - last_verse AS INTEGER) AS start_ord
FROM filled""")
def derived_versification(spark, sf_dir):
    return versify.derive(observed(spark, sf_dir), dims.books(spark), chapter_table(spark))


@query("versification_totals", f"""WITH {vers_cte()}, {DERIVED}, i AS (SELECT *,
  row_number() OVER (PARTITION BY scripture ORDER BY book_ord, chapter) - 1 AS idx,
  sum(last_verse) OVER (PARTITION BY scripture ORDER BY book_ord, chapter) - last_verse AS start_ord FROM filled)
SELECT scripture AS vers_name, book_ord, CAST(max(chapter) AS INTEGER) AS chapter_count, CAST(min(idx) AS INTEGER) AS start_idx,
  CAST(min(start_ord) AS INTEGER) AS start_ord, CAST(sum(sum(last_verse)) OVER (PARTITION BY scripture) AS BIGINT) AS verses
FROM i GROUP BY scripture, book_ord""")
def versification_totals(spark, sf_dir):
    from versewright.session import written

    v = written(versify.derive(observed(spark, sf_dir), dims.books(spark), chapter_table(spark)), "derived")
    d = versify.chapter_counts(v).join(versify.book_starts(v), ["vers_name", "book_ord"])
    return d.join(versify.total_verses(v), "vers_name")


@query("interned_versification", f"""WITH {vers_cte()}, {DERIVED},
chapters_of AS (SELECT scripture, list((book_ord, chapter, last_verse) ORDER BY book_ord, chapter) AS l FROM filled GROUP BY 1),
defaults AS (SELECT vers_name, list((book_ord, chapter, last_verse) ORDER BY book_ord, chapter) AS l FROM vers GROUP BY 1)
SELECT scripture AS vers_name, coalesce(vers_name, scripture) AS same_as
FROM chapters_of LEFT JOIN defaults ON chapters_of.l = defaults.l""")
def interned_versification(spark, sf_dir):
    both = chapter_table(spark)
    return versify.intern(versify.derive(observed(spark, sf_dir), dims.books(spark), both), both)


@query("versification_differences", f"""WITH {vers_cte()}, {DERIVED}, a AS (SELECT book_ord, chapter, last_verse FROM filled
  WHERE scripture = 's2'), b AS (SELECT book_ord, chapter, last_verse FROM vers WHERE vers_name = 'esv')
SELECT book_ord, CAST(chapter AS INTEGER) AS chapter, CAST(last_verse AS INTEGER) AS last_verse, 'left' AS side FROM
  (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
SELECT book_ord, CAST(chapter AS INTEGER), CAST(last_verse AS INTEGER), 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def versification_differences(spark, sf_dir):
    both = chapter_table(spark)
    own = versify.derive(observed(spark, sf_dir), dims.books(spark), both).where("vers_name = 's2'")
    return versify.differences(own, both.where("vers_name = 'esv'"))


@query("versification_choice", f"""WITH {vers_cte()}, {DERIVED}
SELECT o_orderkey, scripture, CASE WHEN scripture IN (SELECT scripture FROM filled) THEN scripture ELSE 'kjv' END AS vers_name
FROM (SELECT o_orderkey, 's' || (o_custkey % 6) AS scripture FROM orders)""")
def versification_choice(spark, sf_dir):
    own = versify.derive(observed(spark, sf_dir), dims.books(spark), chapter_table(spark))
    return versify.choose(table(spark, sf_dir, "orders", "o_orderkey", "'s' || (o_custkey % 6) as scripture"), own)
