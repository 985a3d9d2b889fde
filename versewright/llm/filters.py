"""Which quality filters remove what, in every order they could be applied in, from a sparse document-term matrix.

Texts are read once, in shards of a bounded size. A shard becomes rows of a document-term matrix (CSR: row starts, columns,
counts) over its own words; the words of all shards then get numbers in one dictionary and the columns of each shard are
renumbered. Sums of a row's counts (its words) and its nonzero counts (its different words) decide two of the filters; the
others come with the row. What a document fails is one of 32 sets, so that orders are counted over sets, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import values
from versewright.session import LARGE_ROWS, written

FILTERS = "ABCDE"
#: A shard ends once its texts have so many bytes. It has one row for a document at least.
SHARD_BYTES = 8 << 20
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"

_FIELDS = "doc_id bigint, part string, digest binary, code_points bigint, capitals bigint, marked boolean"
_ROW = f"struct<{_FIELDS.replace(' ', ': ').replace(',:', ',')}>"
_SHARD = f"rows array<{_ROW}>, starts array<bigint>, columns array<int>, counts array<int>, words array<array<binary>>"


class _Words(dict):
    """Numbers of words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _shard(rows: list[tuple], texts: list[bytes], buckets: int) -> pa.RecordBatch:
    words, codes, sizes = _Words(), [], []
    for text in texts:
        tokens = text.split()  # bytes split at \x20 and \x09-\x0D
        codes.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
        sizes.append(len(tokens))
    by_bucket: list[list[bytes]] = [[] for _ in range(buckets)]
    bucket = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
    for word, k in zip(words, bucket.tolist()):
        by_bucket[k].append(word)
    column = np.empty(len(words), np.int64)
    column[np.argsort(bucket, kind="stable")] = np.arange(len(words))
    wide = max(len(words), 1)
    del words
    codes = column[np.concatenate(codes)]
    cells, counts = np.unique(codes + np.repeat(np.arange(len(texts)) * wide, sizes), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(texts) + 1) * wide)
    kind = pa.list_(pa.struct([
        ("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("code_points", pa.int64()),
        ("capitals", pa.int64()), ("marked", pa.bool_())]))
    names = "doc_id", "part", "digest", "code_points", "capitals", "marked"
    return pa.RecordBatch.from_arrays([
        pa.array([[dict(zip(names, r)) for r in rows]], kind), pa.array([starts], pa.list_(pa.int64())),
        pa.array([(cells % wide).astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([by_bucket], pa.list_(pa.list_(pa.binary()))),
    ], ["rows", "starts", "columns", "counts", "words"])


def _sharder(buckets: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(256, bool)
        marks[list(MARKS)] = True
        rows, texts, held = [], [], 0
        for batch in batches:
            for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), values(batch.column("text"))):
                data = np.frombuffer(text, np.uint8)
                rows.append((
                    doc_id, part, hashlib.sha256(text).digest(), int(((data & 0xC0) != 0x80).sum()),
                    int(((data >= 65) & (data <= 90)).sum()), bool(marks[data].any())))
                texts.append(text)
                held += len(text)
                if held >= SHARD_BYTES:
                    yield _shard(rows, texts, buckets)
                    rows, texts, held = [], [], 0
        if rows:
            yield _shard(rows, texts, buckets)

    return shards


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, from 0 in each bucket, of the words of rows sorted by bucket and shard."""
    known, last = _Words(), None
    for batch in batches:
        numbers = []
        for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words")):
            if bucket != last:
                known, last = _Words(), bucket
            words = words.as_py()
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        numbers = pa.array(numbers, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("bucket"), numbers], ["shard", "bucket", "numbers"])


def _encoded(sums: bool):
    """Shards with the columns renumbered; with ``sums`` what each row of them sums up to instead."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cells = (batch.column(c)[i].values for c in ("starts", "columns", "counts", "numbers"))
                starts, columns, counts, numbers = (c.to_numpy(zero_copy_only=False) for c in cells)
                # Within a row, columns stand in the order of the dictionary.
                order = np.lexsort((numbers[columns], np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                columns, counts = numbers[columns[order]], counts[order]
                if not sums:
                    cells = pa.array([columns], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("starts").slice(i, 1), *cells, batch.column("rows").slice(i, 1)], ["starts", "columns", "counts", "rows"])
                    continue
                before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                rows = batch.column("rows")[i].values
                out = dict(zip([f.name for f in rows.type], rows.flatten()))
                out |= {"words": pa.array(before[starts[1:]] - before[starts[:-1]]), "distinct_words": pa.array(np.diff(starts))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return encoded


def dictionary(shards: DataFrame, buckets: int) -> DataFrame:
    """``shard, bucket, numbers`` for the words of each bucket of ``shards (shard, words)``, in their order.

    Words are in buckets by their hash; within a bucket the first shard to hold a word numbers it, in the order of shards,
    so that numbers are alike whenever and wherever a task is run. A task holds the words of one bucket at a time.
    """
    own = shards.select("shard", F.posexplode("words").alias("bucket", "words"))
    own = own.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
    return own.mapInArrow(_numbered, "shard long, bucket int, numbers array<int>")


def matrix(docs: DataFrame, sums: bool = False) -> DataFrame:
    """Document-term matrix of ``docs (doc_id, text, lang)``, a row for each shard: ``starts, columns, counts, rows``.

    ``columns`` are numbers of the dictionary of all shards; ``rows`` describes the documents of the shard. Words are what
    stands between ASCII white space, by case. Null texts are empty ones, a null language is the part ``''``. With ``sums``
    there is a row for each document instead, with its ``words`` and ``distinct_words``.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = written(rows.mapInArrow(_sharder(buckets), _SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards", **LARGE_ROWS)
    # One row a bucket, together as many numbers as the shard has words, which its bytes bound.
    lists = dictionary(shards, buckets).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "numbers"))).alias("lists"))
    whole = F.transform("lists", lambda x: F.transform(x["numbers"], lambda n: n.cast("long") * buckets + x["bucket"]))
    found = shards.drop("words").join(lists.select("shard", F.flatten(whole).alias("numbers")), "shard", "left")
    if sums:
        return found.mapInArrow(_encoded(True), f"{_FIELDS}, words bigint, distinct_words bigint")
    return found.mapInArrow(_encoded(False), f"starts array<bigint>, columns array<bigint>, counts array<int>, rows array<{_ROW}>")


def flagged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, words, distinct_words, code_points, capitals, fails`` of every row of ``docs``.

    ``fails`` is a set of bits: 1 for the filter A (under 200 words), 2 for B (under half of the words are different), 4
    for C (over 3 % capitals A-Z), 8 for D (holds one of ``#$%&*|``), 16 for E (the text of a smaller id). A row without an
    id has none smaller and is smaller than none; rows of one id don't repeat each other.
    """
    rows = written(matrix(docs, True), "flagged")
    # Texts that stand once have no smaller id; of the rest there is a row a text here.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left")
    bit = lambda condition, k: F.when(condition, 1 << k).otherwise(0)
    fails = (
        bit(F.col("words") < LEAST_WORDS, 0) + bit(100 * F.col("distinct_words") < LEAST_DISTINCT_PERCENT * F.col("words"), 1)
        + bit(100 * F.col("capitals") > MOST_CAPITALS_PERCENT * F.col("code_points"), 2) + bit(F.col("marked"), 3)
        + bit(F.col("doc_id") > F.col("first_id"), 4))
    return rows.select("doc_id", "part", "digest", "words", "distinct_words", "code_points", "capitals", fails.alias("fails"))


def steps() -> list[tuple[str, int, int, int, int, int]]:
    """``filter_order, step, filter, before`` for every order of the filters and step: the filter's bit and those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(FILTERS[j] for j in order), step, 1 << k, before))
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, by ``part``, with zeros.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. A row of
    ``docs`` is a document. One id may have several rows of ``labels``: it is good if any has quality 1, toxic if any has
    toxic 1; null ids have no label. An empty table has no parts and gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flagged(docs).select("doc_id", "part", "fails").join(known, "doc_id", "left")
    sets = written(rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")), "sets")
    # A fixed 19,200 rows: every set of filters that a document may fail, at every step of every order.
    every = spark.createDataFrame(steps(), "filter_order string, step int, filter int, before int")
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("fails"))
    at = sets.join(F.broadcast(every), "fails")
    fails, others = F.col("fails").bitwiseAND(F.col("filter")) != 0, F.col("fails").bitwiseAND(F.bitwise_not("filter"))
    gone = F.col("fails").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0))
    found = at.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(here).alias("removed"), total(fails & gone).alias("redundant"),
        total(fails & (others == 0)).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"))
    shares = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "filter"]).drop("filter")


def audit_sql() -> str:
    """The audit of ``documents`` and ``labels`` in SQL."""
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN known USING (doc_id)
), sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own,
    regexp_replace(filter_order, substr(filter_order, step, 1) || '.*', '') AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS f,
    translate(fails, before, '') <> fails AS gone, fails = own AS alone
  FROM sets, steps
), found AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT f AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN f AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN f AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN f AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN f AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found"""
