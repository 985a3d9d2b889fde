"""Hashed runs of letters, for whole texts of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that are hashed at a time.
STEP = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one space, one at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, np.uint32(32))
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)]))
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def ngrams(text: str, shortest: int, longest: int, bits: int) -> Iterator[np.ndarray]:
    """Buckets (of ``2 ** bits``) of the runs of ``shortest`` to ``longest`` letters within words.

    A word's borders count as a letter at either end of a run. Occurrence by occurrence; a word that lies across a step is
    cut there, with the last letters repeated in the next step.
    """
    for start in range(0, len(text), STEP):
        codes = letter_codes(text[max(0, start - longest):start + STEP] if start else text[:STEP])
        hashed, within = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
        for n in range(1, min(longest, len(codes)) + 1):
            size = len(codes) - n + 1
            hashed = (hashed[:size] * np.uint32(0x01000193)) ^ (codes[n - 1:] * np.uint32(0x9E3779B1))
            if n > 2:  # a space only at the borders
                within = within[:size] & (codes[n - 2:n - 2 + size] != 32)
            if n >= shortest:
                found = hashed[within[:size] if n > 1 else codes != 32]
                yield ((found * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64)
