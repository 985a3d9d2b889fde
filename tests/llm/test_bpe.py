import random
import unicodedata
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from versewright.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS) as f:
        return bpe.Encoder(bpe.read_ranks(f.read().splitlines()))


@pytest.fixture(scope="module")
def library(encoder):
    ranks = {t: i for i, t in enumerate(encoder.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_as_the_library_encodes_them(encoder, library):
    rnd, pattern = random.Random(7), regex.compile(public_tokenizers.PATTERN)
    ranges = [range(128), range(0x250), range(0x300, 0xD800), range(0xE000, 0x20000), [32, 10, 0x85, 0x1C, 39]]
    for _ in range(1500):
        text = "".join(chr(rnd.choice(rnd.choice(ranges))) for _ in range(rnd.randrange(80)))
        text = "".join(c for c in text if unicodedata.category(c) != "Cn")
        packed = bpe.encoded(text, pattern, encoder)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_pairs_that_fit_by_merging(encoder):
    rnd = random.Random(1)
    for _ in range(5000):
        a, b = rnd.randrange(len(encoder.tokens)), rnd.randrange(rnd.choice([300, 3000, 50_000]))
        assert encoder.fits(a, b) == (encoder.merged(encoder.tokens[a] + encoder.tokens[b]) == [a, b])


def test_tokens_that_merging_does_not_give():
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"xyz"]
    own = bpe.Encoder(tokens)
    assert own.encode(b"abc") == [258] and own.encode(b"abca") == [258, 97] and own.encode(b"bcab") == [257, 256]
    assert own.encode(b"xyz") == [259] and own.encode(b"xyzx") == [120, 121, 122, 120]


def test_a_long_piece_is_linear(encoder, library):
    text = "abcdefgh" * 30_000
    assert encoder.encode(text.encode()) == library.encode_ordinary(text)


def test_odd_rows(odd, empty, library):
    found = bpe.tokenized(odd, RANKS, public_tokenizers.PATTERN, ("doc_id", "text", "n_tokens", "fp"))
    for r in found.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.fp == 1
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256((r.text or "").encode()).hexdigest()
    assert found.columns == ["doc_id", "text", "fp", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert bpe.tokenized(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.read_ranks(["YQ== 0", "Yg== 2"])
