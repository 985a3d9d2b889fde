"""Removal of passages that stand anywhere else, byte by byte, with suffix arrays of shards.

Every window of ``window`` bytes has an anchor, the smallest hash of the runs of ANCHOR bytes in it, so that equal windows
have equal anchors. Stretches of windows with one anchor are segments; those whose anchor stands once in all texts are done.
The others are dealt by anchor, so that all windows that may be equal meet in one shard, equal segments as one with a count.
The suffix array of a shard and the prefixes that neighbours share (:mod:`versewright.llm.induced`) then tell which windows
repeat. Equal texts are one text with a count before anything else is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import values
from versewright.llm.induced import array, blocks, suffix_order
from versewright.session import written

WINDOW, ANCHOR = 200, 64
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Bytes of segments that a shard should have: it's larger only where one anchor has more.
SHARD_BYTES = 4 << 20

_SYMBOLS = np.random.default_rng(20).integers(0, 1 << 63, 256, np.int64).astype(np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 21) - 1)


def _anchored(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the window from each byte on, the first of equal ones, and hashes by place."""
    hashed, wide, factor = _SYMBOLS[data], 1, np.array([_FACTOR])
    while wide < ANCHOR:
        hashed = hashed[:-wide] * factor + hashed[wide:]
        factor, wide = factor * factor, 2 * wide
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    least = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
    count, wide = window - ANCHOR + 1, 1
    while 2 * wide <= count:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if rest := count - wide:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _PLACE).astype(np.int64), hashed


def segments(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of a text, in its order.

    A segment's windows have their anchor at one place, so that equal windows of a text are in different segments.
    """
    found: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, max(len(data) - window + 1, 0), PIECE):
        places, hashed = _anchored(data[lo:lo + PIECE + window - 1], window)
        heads = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        found.append((hashed[places[heads]].view(np.int64), heads + lo, np.diff(np.append(heads, len(places)))))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(window: int):
    """The anchors of each text, those of several segments twice."""
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in values(batch.column("text")):
                anchor, times = np.unique(segments(text, window)[0], return_counts=True)
                found.append(np.repeat(anchor, np.minimum(times, 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), batch.column("n_bytes"), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_bytes", "anchors"])

    return anchors


def _cut(window: int):
    """The segments of each text whose anchors are shared, each with a digest of what it holds."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64()), ("anchor", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            out = []
            for text, shared in zip(values(batch.column("text")), batch.column("shared")):
                anchor, first, count = segments(text, window)
                at = np.flatnonzero(np.isin(anchor, shared.values.to_numpy()))
                sizes = count[at] + window - 1
                out.append([
                    {"first": i, "size": n, "anchor": a, "content": hashlib.blake2b(text[i:i + n], digest_size=16).digest()}
                    for i, n, a in zip(first[at].tolist(), sizes.tolist(), anchor[at].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("text"), pa.array(out, kind)], ["digest", "text", "segments"])

    return cut


class _Shard:
    """The segments of one shard as one text of symbols: bytes from 2 on, 1 between segments, a last 0."""

    def __init__(self):
        self.text, self.size = array(1 << 20, "u2"), 0
        self.heads: list[int] = []
        self.rows: list[tuple[bytes, int]] = []

    def add(self, content: bytes, segment: bytes, count: int) -> None:
        if self.size + len(segment) + 2 > len(self.text):
            longer = array(2 * (len(self.text) + len(segment)), "u2")
            longer[:self.size] = self.text[:self.size]
            self.text = longer
        self.heads.append(self.size)
        self.rows.append((content, count))
        self.text[self.size:self.size + len(segment)] = np.frombuffer(segment, np.uint8).astype(np.uint16) + 2
        self.size += len(segment) + 1
        self.text[self.size - 1] = 1

    def repeated(self, window: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Digest of each segment in which windows repeat, with the first and the last window of each run of such windows."""
        self.text[self.size] = 0
        order, common = suffix_order(self.text[:self.size + 1], 258)
        again = array(self.size + 1, bool)
        for lo, hi in blocks(len(order)):
            with_next = np.append(common[lo + 1:hi], common[hi] if hi < len(order) else 0)
            again[order[lo:hi]] = np.maximum(common[lo:hi], with_next) >= window
        del order, common
        ends = [*self.heads[1:], self.size]
        for head, end, (content, count) in zip(self.heads, ends, self.rows):
            # Windows end before the symbol between segments; those of a segment with a count stand elsewhere too.
            own = np.ones(end - 1 - head - window + 1, bool) if count > 1 else again[head:end - window]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            if len(edges):
                yield content, edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _repeats(window: int):
    """Runs of repeated windows of each segment, of rows sorted by shard."""
    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None

        def batch_of(rows) -> pa.RecordBatch:
            kinds = pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["content", "starts", "stops"])

        def close() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in shard.repeated(window):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for number, content, segment, n in zip(*(batch.column(c) for c in ("shard", "content", "segment", "n"))):
                if number.as_py() != last:
                    if shard:
                        yield from close()
                    last, shard = number.as_py(), _Shard()
                shard.add(content.as_py(), segment.as_py(), n.as_py())
        if shard:
            yield from close()

    return repeats


def _removed(window: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digest, text, runs in zip(batch.column("digest").to_pylist(), values(batch.column("text")), batch.column("runs")):
                first, last = (runs.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(first, kind="stable")
                first, stop = first[order], last[order] + window
                stop = np.maximum.accumulate(stop)
                heads = np.flatnonzero(np.append(True, first[1:] > stop[:-1]))
                first, stop = first[heads], stop[np.append(heads[1:], len(stop)) - 1]
                kept = hashlib.sha256()
                for a, b in zip([0, *stop.tolist()], [*first.tolist(), len(text)]):
                    kept.update(text[a:b])
                spans = [{"start": a, "stop": b} for a, b in zip(first.tolist(), stop.tolist())]
                out.append((digest, int((stop - first).sum()), len(first), kept.hexdigest(), spans))
            if out:
                kinds = pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["digest", "n_removed", "n_spans", "kept_sha256", "spans"])

    return removed


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What repeats in the texts of ``docs (doc_id, text)``: a row for each row of ``docs``.

    Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``. A byte is removed if a window that covers it
    starts anywhere else too, in the same text or another; windows are judged on the texts as given and don't cross them.
    ``spans`` are the maximal removed runs (start, stop) in bytes. Null texts are empty; texts shorter than a window keep all.
    Rows are texts of their own whatever their ids, so that repeated rows lose all; other columns are not read.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    known = written(rows.mapInArrow(_anchors(window), "doc_id long, digest binary, n_bytes long, anchors array<bigint>"), "anchors")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one")
    texts = known.where(F.col("n_bytes") >= window).groupBy("digest").agg(F.count("*").alias("copies"), one, F.any_value("anchors").alias("anchors"))
    texts = written(texts.select("digest", "copies", F.col("one.doc_id").alias("one_id"), "anchors"), "texts")
    own = texts.select("digest", "one_id", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    shared = own.distinct().join(shared, "anchor").groupBy("digest", "one_id").agg(F.collect_list("anchor").alias("shared"))
    # The text of one row of each group of equal texts; rows that are alike in id and text too give their segments again.
    same = rows["digest"].eqNullSafe(shared["digest"]) & rows["doc_id"].eqNullSafe(shared["one_id"])
    cut = rows.where(F.col("n_bytes") >= window).join(shared, same).select(rows["digest"], "text", "shared")
    kind = "array<struct<first: bigint, size: bigint, anchor: bigint, content: binary>>"
    cut = written(cut.mapInArrow(_cut(window), f"digest binary, text binary, segments {kind}"), "cut")
    bytes_cut = cut.agg(F.sum(F.aggregate("segments.size", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    parts = cut.select("digest", "text", F.explode("segments").alias("s"))
    segment = F.expr("substring(text, cast(s.first as int) + 1, cast(s.size as int))")
    parts = parts.select("s.content", F.pmod(F.xxhash64("s.anchor"), F.lit(bytes_cut // SHARD_BYTES + 1)).alias("shard"), segment.alias("segment"))
    parts = parts.groupBy("content").agg(F.count("*").alias("n"), F.any_value("shard").alias("shard"), F.any_value("segment").alias("segment"))
    parts = parts.repartition(tasks, "shard").sortWithinPartitions("shard", "content")
    again = parts.mapInArrow(_repeats(window), "content binary, starts array<bigint>, stops array<bigint>")
    where = cut.select("digest", F.explode("segments").alias("s")).select("digest", "s.first", "s.content").distinct()
    runs = where.join(again, "content").select("digest", F.explode(F.arrays_zip("starts", "stops")).alias("r"), "first")
    # As many runs as a text has segments, at most half as many as each has windows.
    runs = runs.groupBy("digest").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("r.starts")).alias("a"), (F.col("first") + F.col("r.stops")).alias("b"))).alias("runs"))
    kind = "array<struct<start: bigint, stop: bigint>>"
    found = cut.select("digest", "text").join(runs, "digest").mapInArrow(
        _removed(window), f"digest binary, n_removed long, n_spans long, kept_sha256 string, spans {kind}")
    found = written(found.dropDuplicates(["digest"]), "removed")
    # Of a text that has copies all goes.
    whole = texts.where("copies > 1").select("digest", F.lit(True).alias("whole"))
    rows = known.drop("anchors").join(whole, "digest", "left").join(found, "digest", "left")
    either = lambda copied, own, none: F.when(F.col("whole"), copied).otherwise(F.coalesce(own, none))
    return rows.select(
        "doc_id", "n_bytes", either(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        either(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        either(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
        either(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))), "spans", F.array().cast(kind)).alias("spans"))
