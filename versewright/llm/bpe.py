"""Byte-level BPE over a rank file, in linear time, and its inverse.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton of all tokens (pyahocorasick works on text) finds the
longest token that begins at each place. A piece is covered from the left by longest tokens, and where neighbours don't
fit, the last token is replaced by its next shorter prefix; places from which no cover goes on are remembered. Two
tokens fit if merging the bytes of both by rank gives just these two, which is remembered for each pair. A sequence of
tokens that fit pairwise is what the merges give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewright.llm.common import of_worker, share, values

#: Pieces whose tokens a worker remembers, and the longest of them; beyond it, a piece is encoded anew each time.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 40
#: Pairs that a worker remembers to fit or not.
PAIRS = 1_000_000


class Encoder:
    """Tokens of pieces by the ranks of a vocabulary; the lowest rank is merged first, the leftmost of equal ones."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        # Tokens that merging their own bytes doesn't give stand only for pieces that equal them.
        self.made = [self.merged(t) == [i] for i, t in enumerate(tokens)]
        self.halves = [self._undone(t) if made else (-1, -1) for t, made in zip(tokens, self.made)]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if self.made[i]:
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.lengths = list(map(len, tokens))

    def merged(self, data: bytes) -> list[int]:
        """The merges step by step; for short pieces."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _prefix(self, token: bytes) -> int:
        for stop in range(len(token) - 1, 0, -1):
            i = self.ranks.get(token[:stop])
            if i is not None and self.made[i]:
                return i
        return -1

    def _undone(self, data: bytes) -> tuple[int, int]:
        """The two tokens that the last merge of a token's bytes joins; -1 for single bytes."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 2:
            _, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives just these two.

        Undoes their merges, the latest first, and looks whether at some time the parts on both sides of the border would
        have been joined earlier than what was undone so far.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            tokens, rank, halves, never = self.tokens, self.ranks.get, self.halves, 1 << 40
            left, right, undone = a, b, never
            known = True
            while True:
                if rank(tokens[left] + tokens[right], never) < undone:
                    known = False
                    break
                inner, outer = halves[left][1], halves[right][0]
                if inner < 0 and outer < 0:
                    break
                # Of two merges of one rank the left one comes first, so it is undone last.
                if outer < 0 or inner >= 0 and left > right:
                    undone, left = left, inner
                else:
                    undone, right = right + 1, outer
            self.pairs[key] = known
        return known

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        # The longest token from each place: of those that end somewhere, the longest with a given start.
        longest = [-1] * len(data)
        best = [0] * len(data)
        for stop, (i, length) in self.automaton.iter(data.decode("latin-1")):
            start = stop - length + 1
            if length > best[start]:
                best[start], longest[start] = length, i
        out: list[int] = []
        dead = bytearray(len(data) + 1)
        at, token, end = 0, longest[0], len(data)
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        while True:
            while token >= 0:
                stop = at + lengths[token]
                if not dead[stop] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at == end:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError("a byte has no token")
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]

    def packed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        found = self.encode(piece.encode("utf-8"))
        ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_ranks(lines: list[str]) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 and rank."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def encoded(text: str, pattern: regex.Pattern, encoder: Encoder) -> bytes:
    """Ids of a text, each match of the pattern by itself."""
    known = encoder.pieces.get
    packed = encoder.packed
    return b"".join([known(piece) or packed(piece) for piece in pattern.findall(text)])


def _coder(shared, pattern: str, with_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = of_worker(shared, Encoder), regex.compile(pattern)
        for batch in batches:
            ids, counts, id_digests, text_digests = [], [], [], []
            for text in values(batch.column(COLUMN)):
                packed = encoded(text or "", pieces, encoder)
                counts.append(len(packed) // 4)
                id_digests.append(sha256(packed).hexdigest())
                text_digests.append(sha256(encoder.decode(packed)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
            columns = {c: batch.column(c) for c in batch.schema.names if c != COLUMN}
            columns |= {
                "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_digests, pa.string()),
                "decoded_sha256": pa.array(text_digests, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return code


#: The text within this module, whatever other columns are called.
COLUMN = "__bpe_text"


def tokenized(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs``, and the tokens of every whole text: ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` (of the bytes that the ids give again) and ``ids``.

    ``ranks`` is a rank file that the driver can read (it has as many lines as there are tokens, and goes to the
    executors by broadcast). A null text counts as empty: no tokens and the digests of nothing. Each row stands for itself,
    so repeated rows give equal results and an empty table an empty one. Columns of ``keep`` named like a result are
    replaced by it.
    """
    with open(ranks) as f:
        tokens = read_ranks(f.read().splitlines())
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    keep = tuple(c for c in keep if c not in results)
    shared = share(docs.sparkSession, tokens)
    rows = docs.select(*keep, F.col("text").alias(COLUMN))
    schema = rows.drop(COLUMN).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_coder(shared, pattern, with_ids), schema)
