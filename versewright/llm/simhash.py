"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32 bits. Of two fingerprints that differ in three bits at most, one
segment differs in one bit at most, so that both hold the same segment once the right bit is left out: the index has a
row for each segment and each left-out bit (64 a fingerprint), an equality join finds what shares one, and the whole
fingerprints are then compared. Only different fingerprints are indexed; copies join their group by the fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from versewright.llm.common import components, values
from versewright.session import written

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 3
#: A text is cut into words so many bytes at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: A bucket of more fingerprints than this is cut further by bits of its other segment before it's compared.
BUCKET = 4096
#: How the 32 bits of the other segment are cut, level by level: three bits at most differ, so one of four pieces is equal.
CUTS = ((8, 8, 8, 8), (6, 6, 6, 6), (5, 5, 4, 4))


def _words(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        stop = _SPACE.search(data, start + PIECE)
        stop = stop.end() if stop else len(data)
        yield data[start:stop].split()
        start = stop


def fingerprint(data: bytes) -> int:
    """SimHash of a text in UTF-8, unsigned: a bit is set if it's set in over half the hashes of the shingles."""
    set_bits, count, tail = np.zeros(64, np.int64), 0, []
    for words in _words(data.lower()):
        words = tail + words
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
        tail = words[-(SHINGLE_WORDS - 1):]
    if not count:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * set_bits > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t or b"") for t in values(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found)], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, fp`` of ``doc_id, text``: a row a document, ``digest`` being a hash of its text (null: none)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, digest long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _variants() -> Column:
    """Keys of all 64 (segment, left-out bit), each with what remains of the segment."""
    keys = []
    for bit in range(64):
        segment = F.col("fp").bitwiseAND(0xFFFFFFFF) if bit < 32 else F.shiftrightunsigned("fp", 32)
        keys.append(segment.bitwiseAND(0xFFFFFFFF ^ (1 << bit % 32)).bitwiseOR(F.lit(bit << 32)))
    return F.explode(F.array(*keys))


def _pieces(level: int) -> Column:
    """``(piece, its bits)`` of the segment that the key leaves alone, as far as earlier levels haven't fixed them."""
    first = F.shiftright("key", 32) < 32
    free = F.when(first, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    for done in range(level):  # take the fixed piece out, the rest moves together
        low, starts = F.lit(0), np.cumsum((0, *CUTS[done]))
        for j, bits in enumerate(CUTS[done]):
            at = int(starts[j])
            without = free.bitwiseAND((1 << at) - 1).bitwiseOR(F.shiftleft(F.shiftright(free, at + bits), at))
            low = F.when(F.col("path")[done]["piece"] == j, without).otherwise(low)
        free = low.cast("long")
    starts = np.cumsum((0, *CUTS[level]))
    return F.explode(F.array(*[
        F.struct(F.lit(j).alias("piece"), F.shiftright(free, int(starts[j])).bitwiseAND((1 << bits) - 1).alias("bits"))
        for j, bits in enumerate(CUTS[level])
    ]))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that hold together what is linked within a bucket: one fewer than members, not all pairs."""
    for batch in batches:
        us, vs = [], []
        for members in batch.column("members"):
            rest = np.unique(members.values.to_numpy(zero_copy_only=False).view(np.uint64))
            while len(rest) > 1:
                reached, rest = [rest[0]], rest[1:]
                while reached and len(rest):
                    one = reached.pop()
                    near = np.bitwise_count(rest ^ one) <= MOST_BITS
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        us.append(np.full(len(found), one))
                        vs.append(found)
                        reached.extend(found)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """Links ``u, v`` between the different fingerprints of ``nodes (fp)`` that connect all within three bits.

    Buckets of two are compared where they are counted. Larger ones are gathered, up to ``BUCKET`` fingerprints; beyond
    it, a bucket is cut by equal pieces of the other segment, again and again. After three cuts 15 bits are left, so that
    no list is longer than 32,768 however many fingerprints there are, and no link is lost.
    """
    index = nodes.select("fp", _variants().alias("key"))
    buckets = written(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "buckets")
    found = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS)).select("u", "v")
    # By sorting at every size: the index is many times as large as what it's joined with, and hot keys can be split.
    members = index.join(buckets.where("n > 2").select("key", "n").hint("merge"), "key")
    members = members.withColumn("path", F.expr("cast(array() as array<struct<piece: int, bits: bigint>>)"))
    for level in range(len(CUTS) + 1):
        last = level == len(CUTS)
        full = members if last else members.where(F.col("n") <= BUCKET)
        lists = full.groupBy("key", "path").agg(F.collect_list("fp").alias("members")).select("members")
        found = found.unionByName(lists.mapInArrow(_forest, "u long, v long"))
        if last or (buckets.where(F.col("n") > BUCKET).isEmpty()):
            return found
        cut = members.where(F.col("n") > BUCKET).select("key", "path", "fp", _pieces(level).alias("cut"))
        cut = cut.select("key", "fp", F.concat("path", F.array("cut")).alias("path"))
        buckets = written(cut.groupBy("key", "path").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        members = cut.join(buckets, ["key", "path"])
    raise AssertionError


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, fp, group, component_id`` of every row of ``docs (doc_id, text)``.

    ``group`` is the smallest linked fingerprint (signed). Fingerprints within three bits are linked; ``component_id`` is the smallest id that links lead to. Null and empty
    texts have fingerprint zero and are linked like any other. A row without an id is linked too, but gives a group no
    id: a group of such rows alone has a null ``component_id``. Repeated rows are in one group. An empty table gives an
    empty one; other columns are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    parts = components(links(nodes)).withColumnRenamed("node", "fp")
    known = nodes.join(parts, "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    ids = known.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    known = written(known.select("fp", "group").join(ids, "group"), "groups")
    return rows.join(known, "fp").select("doc_id", "digest", "fp", "group", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates: that with the smallest id, and of repeated rows one.

    Rows without an id come last, then the smallest text digest decides.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    kept = near_duplicates(docs).groupBy("group").agg(first)
    kept = kept.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.digest").alias("__kept_digest"))
    keyed = docs.withColumn("__row_digest", F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]) & keyed["__row_digest"].eqNullSafe(kept["__kept_digest"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__row_digest"]).drop("__row_digest")
