from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilspark.llm import bpe, packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a", "\n\n  x", "'s't'LL", "<|endoftext|>", "漢字 ﬁ", "😀😀", "aaaaaaaaaaaaaaaaaaaaaaaa", "." * 3000, "½² x٣", "a\u0085b c", "é" * 50]


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


def test_perfect_hash(codec):
    keys = list(codec.ranks)
    places = codec.hash.places(keys)
    assert sorted(places.tolist()) == list(range(len(keys))) and all(codec.hash.key[p] == k for p, k in zip(places.tolist(), keys))


def test_codec(codec):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(8)
    for text in [*ODD, *("".join(rng.choice("abcdefg hiäöü0123.,'\n") for _ in range(rng.randint(0, 300))) for _ in range(300))]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_memory_changes_nothing(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    text = " ".join(f"xq{i % 11}zz" for i in range(200))
    assert codec.encode(text) == codec.encode(text)


def test_byte_bpe(docs, texts, none):
    got = bpe.byte_bpe(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect()
    own = Tokenizer.from_file(FILE)
    own.encode_special_tokens = True  # this operator knows no special tokens
    want = []
    for d, t in texts:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert bpe.byte_bpe(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_encoders_agree():
    own = Tokenizer.from_file(FILE)
    with open(FILE, encoding="utf-8") as f:
        vocabulary = f.read()
    for text in [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "é<|endoftext|>", "漢<|endoftext|>字", "<|endoftext|"]:
        assert packing.encode(text, vocabulary) == own.encode(text, add_special_tokens=False).ids


def test_differencing():
    rng = random.Random(1)
    for n, m in ((1, 1), (7, 3), (200, 20), (3, 5)):
        sizes = [rng.randint(1, 170) for _ in range(n)]
        loads, where = packing.difference(sizes, m)
        want = [0] * m
        for s, w in zip(sizes, where):
            want[w] += s
        assert sorted(loads.tolist()) == sorted(want)
    loads, _ = packing.difference([rng.randint(1, 170) for _ in range(2000)], 100)
    assert loads.max() - loads.min() <= 12


@pytest.mark.parametrize("sizes", [[], [1], [1023], [1024], [1025], [700, 700], list(range(1, 400)), [5000, 3, 3, 1018]])
def test_packer(sizes):
    packer = packing.Packer(1024, 7 << 40)
    rows = [r for d, n in enumerate(sizes) for r in packer.take(d, np.arange(n, dtype=np.uint32))] + packer.end()
    check(rows, {d: np.arange(n, dtype=np.uint32) for d, n in enumerate(sizes)})
    padded = sum({r[4]: r[7] for r in rows}.values())
    assert padded - sum(sizes) <= max(1024 * 0.1, 0.03 * sum(sizes))


def check(rows, ids):
    """Every id in exactly one piece, sequences without gaps and of the capacity at most, padding as stated."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, total, sequence, offset, size, padded, data in rows:
        own = np.frombuffer(bytes(data), "<u4")
        assert length == len(own) > 0 and total == len(ids[doc]) and (own == ids[doc][start : start + length]).all()
        pieces[doc].append((start, length))
        sequences[sequence].append((offset, length, size, padded))
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for offset, length, size, padded in sorted(own):
            assert offset == at and size <= 1024 and padded == (size if size & (size - 1) == 0 else 1024)
            at += length
        assert at == own[0][2]


def test_pack_sequences(spark, texts, none):
    own = Tokenizer.from_file(FILE)
    rows = [(i, t) for i, (_, t) in enumerate([*texts, (0, "a <|endoftext|> b")])]
    got = packing.pack_sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), FILE).collect()
    check([tuple(r) for r in got], {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in rows})
    assert packing.pack_sequences(none, FILE).count() == 0


def test_latin_pattern():
    import regex

    own, fast = regex.compile(public_tokenizers.PATTERN), bpe.latin(public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(chr(rng.choice((rng.randrange(256), 32, 39, 115))) for _ in range(rng.randint(0, 40)))
        assert own.findall(text) == fast.findall(text)
    assert bpe.latin(r"\d+") is None
