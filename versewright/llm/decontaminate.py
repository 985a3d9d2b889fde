"""Benchmark decontamination: a BM25 index of the test items, asked with every passage of every document.

Items of like length make an index. Its postings hold for each word the items with their impact: the BM25 weight, as a
share of the score that the item itself would get, so that one threshold holds for items of any length. Postings are cut
into blocks of items with the block's largest impact (block-max). A document is cut into overlapping passages, twice as
long as the longest item, so that a copy of an item lies wholly in one of them. For all passages of a document at once
the block maxima are summed; what can't reach the threshold is left out, and the rest is retrieved by WAND: word lists
ordered by their next item, the pivot where the bounds reach the threshold, a full score only if the block maxima there
reach it too. Retrieved items are then verified by the overlap of question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewright.llm.common import of_worker, share, values
from versewright.session import written

K1, B = 1.2, 0.75
#: Least BM25 score as a share of an item's score with itself.
LEAST_SCORE = 0.5
#: Least share of the question's and the answer's shingles of five words that lie in the passage.
LEAST_OVERLAP, SHINGLE_WORDS = 0.8, 5
BLOCK_ITEMS = 4
#: Items of up to so many words share an index; longer ones go by powers of two.
SHORT_ITEM = 64
#: Postings in one index that goes to the executors; more items make more indexes, each asked with all documents.
POSTINGS = 1_000_000
#: Sums of block maxima held at a time.
BOUNDS = 1 << 22
#: Words of a document worked on at a time.
STEP_WORDS = 1 << 17

WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.?!]\s+(?=\S)")


#: What isn't part of a word in ASCII becomes a space.
_ASCII = {i: " " for i in range(128) if not WORD.match(chr(i))}


def words_of(text: str) -> list[str]:
    text = text.lower()
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what is before it the question; a single sentence is the question alone."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    return (text[:ends[-1]], text[ends[-1]:]) if ends else (text, "")


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE_WORDS, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of a part's shingles that the passage holds; a part without words is held."""
    wanted = _shingles(part)
    if not wanted:
        return 1.0
    n = min(SHINGLE_WORDS, len(part))
    there = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
    return len(wanted & there) / len(wanted)


@dataclass
class Index:
    """An inverted index of some items, all at most ``longest`` words long."""

    ids: list
    parts: list[tuple[list[str], list[str]]]  # question and answer
    longest: int
    terms: dict[str, int]
    postings: list[tuple[np.ndarray, np.ndarray]]  # items, rising, and their impacts
    #: Entries of a term and a block that holds it, by term: where the term's begin, the block, its largest impact, and from
    #: where to where its postings lie within the term's. There are no more of them than postings.
    first_entry: np.ndarray
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_start: np.ndarray
    entry_stop: np.ndarray

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK_ITEMS)

    def _entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of these terms, and the place of each one's term in ``terms``."""
        counts = self.first_entry[terms + 1] - self.first_entry[terms]
        of = np.repeat(np.arange(len(terms)), counts)
        return np.arange(len(of)) - (np.cumsum(counts) - counts)[of] + self.first_entry[terms][of], of

    def _bounds(self, terms: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Sums of block maxima by row and block; ``row`` is that of each term."""
        entries, of = self._entries(terms)
        return np.bincount(row[of] * self.blocks + self.entry_block[entries], self.entry_max[entries], rows * self.blocks).reshape(rows, self.blocks)

    def search(self, words: list[str], least: float) -> Iterator[tuple[int, int, int, float]]:
        """``start, end, item, score`` of all items above the threshold, passage by passage."""
        get = self.terms.get
        numbers = np.array(list(map(get, words, repeat(-1))), np.int64)
        known = np.flatnonzero(numbers >= 0)
        if not len(known):
            return
        # Each place lies in the passage of its stretch and in the one before. A word counts once in a passage.
        stretch, own = known // self.longest, numbers[known]
        last = max(0, -(-(len(words) - self.longest) // self.longest) - 1)
        size = len(self.terms)
        pairs = np.unique(np.concatenate((
            np.minimum(stretch, last) * size + own, (np.maximum(stretch, 1) - 1) * size + own)))
        passage, own = np.divmod(pairs, size)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(passage)) + 1))
        edges = [*starts.tolist(), len(own)]
        step = max(1, BOUNDS // self.blocks)
        for a in range(0, len(starts), step):
            b = min(a + step, len(starts))
            row = np.repeat(np.arange(b - a), np.diff(edges[a:b + 1]))
            bounds = self._bounds(own[edges[a]:edges[b]], row, b - a)
            for k in np.flatnonzero(bounds.max(axis=1) >= least - 1e-6).tolist():
                start = int(passage[edges[a + k]]) * self.longest
                for item, score in self.wand(own[edges[a + k]:edges[a + k + 1]], least, bounds[k]):
                    yield start, start + 2 * self.longest, item, score

    def wand(self, terms: np.ndarray, least: float, bounds: np.ndarray | None = None) -> Iterator[tuple[int, float]]:
        """Items whose impacts over these different terms sum to ``least``, by block-max WAND.

        ``bounds`` are the sums of the terms' block maxima. Blocks that can't reach the threshold are skipped; within the
        others only the postings of the block are opened.
        """
        if bounds is None:
            bounds = self._bounds(terms, np.zeros(len(terms), np.int64), 1)[0]
        entries, of = self._entries(terms)
        blocks = self.entry_block[entries]
        for block in np.flatnonzero(bounds >= least - 1e-6).tolist():
            there = np.flatnonzero(blocks == block)
            alive = []
            for t, e in zip(terms[of[there]].tolist(), entries[there].tolist()):
                items, impacts = self.postings[t]
                start, stop, most = self.entry_start[e], self.entry_stop[e], float(self.entry_max[e])
                alive.append((items[start:stop].tolist(), impacts[start:stop].tolist(), most))
            yield from self._within(alive, least - 1e-9)

    @staticmethod
    def _within(lists: list[tuple[list[int], list[float], float]], least: float) -> Iterator[tuple[int, float]]:
        """WAND over the lists of one block, document at a time."""
        alive = [(items[0], 0, k) for k, (items, _, _) in enumerate(lists)]
        while alive:
            alive.sort()
            total, pivot = 0.0, -1
            for _, _, k in alive:
                pivot += 1
                total += lists[k][2] + 1e-9
                if total >= least:
                    break
            else:
                return
            item = alive[pivot][0]
            if alive[0][0] == item:
                score = sum(lists[k][1][at] for x, at, k in alive if x == item)
                if score >= least:
                    yield item, score
                target = item + 1
            else:
                target = item
            moved = []
            for x, at, k in alive:
                items = lists[k][0]
                while x < target:
                    at += 1
                    if at == len(items):
                        break
                    x = items[at]
                else:
                    moved.append((x, at, k))
            alive = moved


def build(items: list[tuple[object, str]], document_count: int, frequency: dict[str, int], average: float) -> Index:
    """An index of ``(id, text)``; counts and the average length are those of all items."""
    split = [tuple(map(words_of, question_and_answer(text))) for _, text in items]
    postings: dict[str, list[tuple[int, float]]] = {}
    for n, (question, answer) in enumerate(split):
        words = question + answer
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(words) / average)
        impacts = {
            w: np.log(1 + (document_count - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + norm)
            for w, c in counts.items()
        }
        own = sum(impacts.values())
        for w, x in impacts.items():
            postings.setdefault(w, []).append((n, x / own))
    terms = {w: i for i, w in enumerate(sorted(postings))}
    lists, first_entry, entries = [], [0], [[], [], [], []]
    for w in terms:
        numbers, impacts = np.array([n for n, _ in postings[w]]), np.array([x for _, x in postings[w]])
        lists.append((numbers, impacts))
        blocks, begins = np.unique(numbers // BLOCK_ITEMS, return_index=True)
        for all_of, own in zip(entries, (blocks, np.maximum.reduceat(impacts, begins), begins, np.append(begins[1:], len(numbers)))):
            all_of.append(own)
        first_entry.append(first_entry[-1] + len(blocks))
    entries = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in entries]
    longest = max(SHORT_ITEM, max((len(q) + len(a) for q, a in split), default=0))
    return Index([i for i, _ in items], split, longest, terms, lists, np.array(first_entry), *entries)


def leaks(text: str, indexes: list[Index], least_score: float, least_overlap: float) -> list[tuple]:
    """``item id, score, share of the question, share of the answer``, the best passage for each item."""
    found: dict = {}
    words = words_of(text)
    for index in indexes:
        step = max(STEP_WORDS, 8 * index.longest)
        for start in range(0, max(1, len(words)), step):
            piece = words[start:start + step + 2 * index.longest]
            for a, b, item, score in index.search(piece, least_score):
                question, answer = index.parts[item]
                shares = overlap(question, piece[a:b]), overlap(answer, piece[a:b])
                if min(shares) >= least_overlap - 1e-9:
                    key = index.ids[item]
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    return [(key, *found[key]) for key in sorted(found)]


_LEAKS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"
_LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
TEXT, FOUND = "__bm25_text", "__bm25_leaks"


def _searcher(shared, least_score: float, least_overlap: float, with_text: bool):
    names = [f.name for f in _LEAK]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = of_worker(shared)
        for batch in batches:
            found = [before + [dict(zip(names, x)) for x in leaks(text or "", indexes, least_score, least_overlap)]
                     for text, before in zip(values(batch.column(TEXT)), batch.column(FOUND).to_pylist())]
            columns = {c: batch.column(c) for c in batch.schema.names if c != FOUND and (with_text or c != TEXT)}
            yield pa.RecordBatch.from_pydict(columns | {FOUND: pa.array(found, pa.list_(_LEAK))})

    return search


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array(map(words_of, batch.column("text").to_pylist()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), words], ["item_id", "text", "words"])


def indexes_of(items: DataFrame) -> Iterator[list[Index]]:
    """Groups of indexes, each of about ``POSTINGS`` postings. Items are ``item_id, text``; those without a word are left out.

    Counts over all items are taken by Spark; the driver gets the items and counts of one group at a time.
    """
    rows = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).distinct()
    rows = rows.mapInArrow(_item_words, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    rows = written(rows.withColumn("different", F.array_distinct("words")), "items")
    total = rows.agg(F.count("*").alias("items"), F.avg(F.size("words")).alias("length"), F.sum(F.size("different")).alias("postings")).first()
    if not total["items"]:
        return
    parts = -(-total["postings"] // POSTINGS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    terms = rows.select("part", F.explode("different").alias("word"))
    counts = terms.groupBy("word").agg(F.count("*").alias("n"))
    for p in range(parts):
        own = [(r["item_id"], r["text"]) for r in rows.where(F.col("part") == p).orderBy("item_id", "text").select("item_id", "text").collect()]
        used = terms.where(F.col("part") == p).select("word").distinct()
        frequency = {r["word"]: r["n"] for r in counts.join(used, "word").collect()}
        classes: dict[int, list] = {}
        for i, text in own:
            classes.setdefault(max(SHORT_ITEM, 1 << (len(words_of(text)) - 1).bit_length()), []).append((i, text))
        yield [build(x, total["items"], frequency, total["length"]) for _, x in sorted(classes.items())]


def _searched(docs: DataFrame, items: DataFrame, least_score: float, least_overlap: float, with_text: bool) -> DataFrame:
    groups = [share(docs.sparkSession, x) for x in indexes_of(items)]
    rows = docs.withColumn(FOUND, F.array().cast(_LEAKS))
    for n, shared in enumerate(groups):
        text_too = with_text or n + 1 < len(groups)  # the next group asks again
        asked = _searcher(shared, least_score, least_overlap, text_too)
        rows = rows.mapInArrow(asked, rows.drop(*[FOUND] if text_too else [FOUND, TEXT]).schema.add(rows.schema[FOUND]))
    return rows


def contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``leaks``: the items that a text holds, with score and overlaps.

    ``docs`` needs ``text``, ``items`` has ``item_id, text``. Null and empty texts and items leak nothing, nor do items of
    punctuation alone; repeated items of one id count once, and items with equal texts all leak. Every row stands for itself.
    Without items every list is empty, without documents there are no rows. A column of ``keep`` named ``leaks`` is replaced.
    """
    keep = tuple(c for c in keep if c != "leaks")
    rows = docs.select(*keep, F.col("text").alias(TEXT))
    return _searched(rows, items, least_score, least_overlap, False).select(*keep, F.col(FOUND).alias("leaks"))


def clean(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """``docs`` without those that hold an item; every other row stays as it is, null and empty texts too."""
    rows = _searched(docs.withColumnRenamed("text", TEXT), items, least_score, least_overlap, True)
    return rows.where(F.size(FOUND) == 0).withColumnRenamed(TEXT, "text").select(*docs.columns)
