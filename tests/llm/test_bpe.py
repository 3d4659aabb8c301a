"""BPE by distinct words: against the vocabulary's own library, round trips, odd rows."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from strandline.llm import bpe
from strandline.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    pools = ["abc XYZ'sdtl'll \n\t", "0189²³¼ ٣४Ⅷ", "éßñ ·ºªÿ_-", "你好世界، שלום 　 \x1c\x1f\x85\xa0", "👍🏽‍﻿́é ", "<|endoftext|> "]
    out = ["", " ", "\n\n  \n", "a", "'s 'S 'll", "x" * 5000, "ab" * 700 + "é" * 900, "   leading", "trailing   ", " \t a", "it's they'Re we'll", "-" * 300, "word " * 2000]
    for _ in range(300):
        pool = "".join(rng.sample(pools, rng.randint(1, 3)))
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 80))))
    out += ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 256)]
    return out


def test_words_are_those_of_the_pattern():
    fast, slow = bpe.Splitter(), bpe.regex.compile(public_tokenizers.PATTERN)
    assert bpe.PATTERN == public_tokenizers.PATTERN
    plain = [chr(c) for c in range(0x250) if not bpe.NOT_PLAIN.search(chr(c))]
    for c in plain:
        for t in (c, f"a{c}b", f"1{c}2", f" {c} ", f" {c}{c}x", f"'{c}", f"!{c}?"):
            assert fast(t) == slow.findall(t)
    for t in texts():
        assert fast(t) == slow.findall(t)


def test_word_encoding_short_and_long(ranks, library):
    for t in texts():
        for w in bpe.Splitter()(t):
            raw = w.encode()
            want = library._core_bpe.encode_single_piece(raw)
            assert bpe.encode_word(raw, ranks) == want
            if raw not in ranks:
                assert bpe._encode_long(raw, ranks) == want


@pytest.mark.parametrize("hot", [0, 40, 1 << 18])
def test_documents_as_the_library_encodes_them(spark, ranks, library, hot):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(9000, None, "x", 1), (None, "null id é", "x", 1), (1, "another text of an id", "x", 1), (5, "x" * 5000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, pos int").repartition(5)
    encoded = bpe.encode_documents(docs, ranks, words=hot)
    want = sorted((str(r[0]), library.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == want
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in bpe.decode_documents(encoded, ranks).collect()) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)


def test_repeated_rows_and_large_vocabularies(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b" ab": 70_000}
    docs = spark.createDataFrame([(1, "ab abab zq ab")] * 7 + [(2, "zq")], "doc_id long, text string")
    out = bpe.encode_documents(docs, ranks, words=2, sample=1).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in out) == [(1, [256, 32, 257, 32, 122, 113, 70_000])] * 7 + [(2, [122, 113])]


def test_places_as_bytes():
    numbers = [0, 1, 127, 128, 129, 16_383, 16_384, 2_097_151, 2_097_152, 5, 0]
    assert bpe.places_of(b"".join(map(bpe.place_code, numbers))).tolist() == numbers
    assert bpe.places_of(b"").tolist() == []


def test_digests(spark, ranks, library):
    import hashlib

    docs = spark.createDataFrame([(1, "Ein Satz über Möhren."), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in bpe.digest_encoding(bpe.encode_documents(docs, ranks), ranks).collect()}
    ids = library.encode_ordinary("Ein Satz über Möhren.")
    assert out[1]["n_tokens"] == len(ids) and out[2]["n_tokens"] == 0
    assert out[1]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert out[1]["decoded_sha256"] == hashlib.sha256("Ein Satz über Möhren.".encode()).hexdigest()
    assert out[2]["ids_sha256"] == out[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_ids_that_the_vocabulary_lacks():
    table = bpe.TokenBytes({b"a": 0, b"bc": 2})
    assert table(bpe.np.array([2, 0, 2])) == b"bcabc" and table(bpe.np.array([], int)) == b""
    for bad in (1, 3, -1):
        with pytest.raises(ValueError):
            table(bpe.np.array([0, bad]))


def test_empty_table(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest_encoding(bpe.encode_documents(none, ranks), ranks).count() == 0
    assert bpe.decode_documents(bpe.encode_documents(none, ranks), ranks).count() == 0
