"""Line deduplication by pairwise alignment.

Documents that overlap are found through the hashes of what they share: each line, and each shortest run of lines that has
enough words, nominates one partner for every later document that holds it, the earliest one. So a line of n documents gives
n - 1 pairs however common it is, and the first copy is never deleted; runs name the documents that hold a passage as a
whole. Pairs whose nominations have enough words are brought together with all their lines and aligned by patience diff.
What goes from the later document are runs of lines that lie, in their order, in the blocks of one alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from versewright.llm.common import values
from versewright.session import written

#: Blocks of fewer words stay: headings, licence lines and other short lines repeat by nature.
LEAST_WORDS = 20

_NAME = "struct<key: bigint, words: int>"
_DOC = f"doc_id long, digest long, keys array<bigint>, words array<int>, names array<{_NAME}>"


def _runs(keys: list[int], words: list[int], least_words: int) -> Iterator[tuple[int, int, int]]:
    """First and last place and hash of the shortest runs of several lines, from each place and up to each, that have the words.

    Blank lines (key 0) end a run. Every line of a passage with enough words is in a run that lies within the passage.
    """
    found, stop, total = set(), 0, 0
    for start in range(len(keys)):
        if stop <= start:
            stop, total = start, 0
        while total < least_words and stop < len(keys) and keys[stop]:
            total += words[stop]
            stop += 1
        if total >= least_words and keys[start]:
            last = stop - 1
            # From the last line backwards, the run may be shorter.
            first, backwards = last, words[last]
            while backwards < least_words:
                first -= 1
                backwards += words[first]
            found |= {(start, last), (first, last)}
        total -= words[start] if stop > start else 0
    # Up to places that no run from another place ends at.
    start, total = 0, 0
    for stop in range(len(keys)):
        if not keys[stop]:
            start, total = stop + 1, 0
            continue
        total += words[stop]
        while total - words[start] >= least_words:
            total -= words[start]
            start += 1
        if total >= least_words:
            found.add((start, stop))
    for first, last in sorted(found):
        if last > first:
            run = b"".join(k.to_bytes(8, "little", signed=True) for k in keys[first:last + 1])
            yield first, last, xxh3_64_intdigest(b"\n" + run) - (1 << 63)


def _liner(least_words: int):
    """The lines of each document, blank ones as key 0, and what nominates partners for it."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), values(batch.column("text"))):
                keys, words = [], []
                for line in text.split(b"\n"):
                    parts = line.split()
                    keys.append((xxh3_64_intdigest(b" ".join(parts)) - (1 << 63) or 1) if parts else 0)
                    words.append(len(parts))
                names = {k: n for k, n in zip(keys, words) if k}
                for first, last, key in _runs(keys, words, least_words):
                    names[key] = sum(words[first:last + 1])
                out.append({"doc_id": doc_id, "digest": digest, "keys": keys, "words": words, "names": [{"key": k, "words": n} for k, n in names.items()]})
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _DOC_TYPE)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _DOC_TYPE)

    return lines


_DOC_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.int64()), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())),
    ("names", pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32())])))])


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, in which the second rises too (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, (_, right) in enumerate(pairs):
        pile = bisect_left(tops, right)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(right)
            piles.append(i)
        else:
            tops[pile], piles[pile] = right, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def aligned(later: list[int], earlier: list[int]) -> dict[int, int]:
    """Places of a later document with the places of an earlier one that patience diff aligns them with.

    Lines that are single in both are anchors (where there are none, equal occurrences of repeated lines); the longest rising
    run of anchors is kept and grown up and down over equal lines. Both documents are lists of keys, 0 being a blank line.
    """
    left, right = _places(later), _places(earlier)
    anchors = [(left[k][0], right[k][0]) for k in left if len(left[k]) == len(right.get(k, ())) == 1]
    anchors = anchors or [x for k in left for x in zip(left[k], right.get(k, ()))]
    taken: dict[int, int] = {}
    used: set[int] = set()
    for p, q in _longest_rising(sorted(anchors)):
        for step, p, q in ((1, p, q), (-1, p - 1, q - 1)):
            while 0 <= p < len(later) and 0 <= q < len(earlier) and later[p] == earlier[q] != 0 and p not in taken and q not in used:
                taken[p] = q
                used.add(q)
                p, q = p + step, q + step
    return taken


def _places(keys: list[int]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for place, key in enumerate(keys):
        if key:
            found.setdefault(key, []).append(place)
    return found


def _cuts(later: list[int], words: list[int], earlier: list[int], earlier_words: list[int], least_words: int) -> list[tuple[int, int]]:
    """Runs of lines of the later document, both ends included, that the alignment with one earlier document deletes.

    Lines are in a run if they follow each other and are aligned in order, with at least ``least_words`` words together.
    Passages that have moved are aligned by themselves, from a run of lines that stands in both.
    """
    rising = aligned(later, earlier)
    found, run = [], []
    for place in [*sorted(rising), -2]:
        if run and place != run[-1] + 1:
            if sum(words[p] for p in run) >= least_words:
                found.append((run[0], run[-1]))
            run = []
        run.append(place)
    moved = {}
    for first, _, key in _runs(earlier, earlier_words, least_words):
        moved.setdefault(key, first)
    moved |= {k: q[0] for k, q in _places(earlier).items() if earlier_words[q[0]] >= least_words}
    singles = [(p, p, k) for p, k in enumerate(later) if k and words[p] >= least_words]
    gone = {p for a, b in found for p in range(a, b + 1)}
    for first, last, key in sorted([*_runs(later, words, least_words), *singles]):
        if key in moved and not gone.issuperset(range(first, last + 1)):
            p, q = first, moved[key]
            while p < len(later) and q < len(earlier) and later[p] == earlier[q] != 0:
                p, q = p + 1, q + 1
            if p > last:
                found.append((first, p - 1))
                gone.update(range(first, p))
    return found


def _aligner(least_words: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        names = "keys", "words", "first_keys", "first_words"
        for batch in batches:
            cuts = []
            for pair in zip(*(batch.column(c) for c in names)):
                cuts.append([{"start": a, "stop": b} for a, b in _cuts(*(c.as_py() for c in pair), least_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), batch.column("first_id"), pa.array(cuts, kind)],
                ["doc_id", "digest", "first_id", "cuts"])

    return align


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all partners put together where they overlap or touch."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = []
        for cuts in batch.column("cuts"):
            runs: list[list[int]] = []
            for start, stop in sorted((c["start"], c["stop"]) for c in cuts.as_py()):
                if runs and start <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            out.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(out, kind), batch.column("partners")], ["doc_id", "digest", "cuts", "partners"])


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, digest, cuts, partners``: lines to delete of each later document that has any, with the earlier ones."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    lines = written(rows.where(F.col("text").isNotNull()).mapInArrow(_liner(least_words), _DOC), "lines")
    names = lines.select("doc_id", "digest", F.inline("names"))
    holder = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    first = names.groupBy("key").agg(F.min(holder).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = first.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    pairs = names.join(first, "key").where("doc_id is null or doc_id > first_id")
    # Repeated rows nominate alike: each key counts once.
    pairs = pairs.groupBy("doc_id", "digest", "first_id", "first_digest").agg(F.sum("words").alias("shared"))
    pairs = written(pairs.where(F.col("shared") >= least_words).drop("shared"), "pairs")
    texts = lines.select("doc_id", "digest", "keys", "words").dropDuplicates(["doc_id", "digest"])
    earlier = texts.select(*[F.col(c).alias(f"first_{c}") for c in ("digest", "keys", "words")], F.col("doc_id").alias("first_id"))
    later = texts.withColumnsRenamed({"doc_id": "own_id", "digest": "own_digest"})
    together = pairs.join(earlier, ["first_id", "first_digest"])
    together = together.join(later, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    cuts = together.mapInArrow(_aligner(least_words), "doc_id long, digest long, first_id long, cuts array<struct<start: int, stop: int>>")
    cuts = cuts.where(F.size("cuts") > 0).groupBy("doc_id", "digest").agg(
        F.flatten(F.collect_list("cuts")).alias("cuts"), F.array_sort(F.collect_set("first_id")).alias("partners"))
    return cuts.mapInArrow(_merged, "doc_id long, digest long, cuts array<struct<start: int, stop: int>>, partners array<bigint>")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, cuts: str = "line_cuts", partners: str = "line_partners") -> DataFrame:
    """``docs`` without the lines of aligned blocks, with the deleted runs and the earlier documents they were found in.

    Lines are compared by their words. Earlier is the smaller id. A run of lines that are aligned, in order, with an earlier
    document is deleted if it has ``least_words`` words. Null and empty texts stay as they are; a text that loses all lines becomes
    empty. Rows without an id come after all others and are never the earlier side; rows with one id are versions of one
    document, get their own cuts and delete nothing from each other; repeated rows are cut alike. ``n_chars``, if there is
    such a column, follows the text. Columns named as ``cuts`` or ``partners`` are replaced.
    """
    found = repeated_lines(docs, least_words)
    found = found.select(*[F.col(c).alias(f"__cut_{c}") for c in found.columns])
    base = docs.drop(cuts, partners).withColumn("__row_digest", F.xxhash64("text"))
    rows = base.join(found, base["doc_id"].cast("long").eqNullSafe(found["__cut_doc_id"]) & (base["__row_digest"] == found["__cut_digest"]), "left")
    ends = F.col("__cut_cuts")
    # What stays: from the line after a run to the line before the next one.
    starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda r: r["stop"] + 1))
    text = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.flatten(F.transform(
        F.arrays_zip(starts.alias("a"), F.concat(F.transform(ends, lambda r: r["start"]), F.array(F.size(lines))).alias("b")),
        lambda keep: F.slice(lines, keep["a"] + 1, keep["b"] - keep["a"]))), "\n"))[0]
    rows = rows.withColumn("text", F.when(ends.isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(ends.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    empty = F.array().cast("array<struct<start: int, stop: int>>")
    return rows.select(
        *[c for c in docs.columns if c not in (cuts, partners)], F.coalesce(ends, empty).alias(cuts),
        F.coalesce("__cut_partners", F.array().cast("array<bigint>")).alias(partners))
