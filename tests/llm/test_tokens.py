"""Counting, encoding and decoding against the libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing, token_counts

PARTS = [*"ab'sSt  \n\t \x1c\x85é́ßΣ漢字1234!?.<>|-_́😀İ", "<|endoftext|>", "'ll", " the", "<|startoftext|>"]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTE_JSON, WORD_JSON = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(n=3000):
    chosen = random.Random(1)
    found = ["".join(chosen.choice(PARTS) for _ in range(chosen.randint(0, 40))) for _ in range(n)]
    return [*found, "a" * 3000, " " * 700 + "x", "ab" * 700, "\n" * 600, "word " * 5000, ""]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_the_text():
    for text in texts(500):
        assert "".join(token_counts.safe_pieces(text)) == text


def test_counts_are_the_library_s():
    counter, tokenizer = token_counts.PieceCounter(BYTE_JSON), Tokenizer.from_file(BYTE_JSON)
    for text in texts():
        assert counter(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    wanted = [token_counts.PieceCounter(BYTE_JSON)(x) for x in texts(200)]
    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 5)
    counter = token_counts.PieceCounter(BYTE_JSON)
    assert [counter(x) for x in texts(200)] == wanted


def test_words_have_the_library_s_ids():
    encoder, tokenizer = packing.WordEncoder(WORD_JSON), Tokenizer.from_file(WORD_JSON)
    found = encoder([x.encode() for x in texts()])
    for text, ids in zip(texts(), found):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_are_the_library_s(library):
    bpe = byte_bpe.ByteBPE(RANKS, PATTERN)
    for text, ids in zip(texts(), bpe.encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_long_and_short_words_merge_alike(library):
    bpe = byte_bpe.ByteBPE(RANKS, PATTERN)
    chosen = random.Random(2)
    for n in (1, 2, 7, 60, 300):
        word = bytes(chosen.choice(b"abcdethnio ") for _ in range(n))
        assert bpe.merge_long(word) == bpe.merge_matrix([word])[0]


def frame(spark):
    rows = [(i, x, "clash", "clash") for i, x in enumerate(texts(60))] + [(7, None, None, None), (7, "one two", "", ""), (None, "x", "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id string").repartition(3)


def test_count_table(spark):
    df, tokenizer = frame(spark), Tokenizer.from_file(BYTE_JSON)
    found = token_counts.token_counts(df, BYTE_JSON, limit=20).collect()
    wanted = []
    for row in df.collect():
        n = len(tokenizer.encode(row["text"] or "", add_special_tokens=False).ids)
        wanted.append((row["doc_id"], len((row["text"] or "").encode()), n, n > 20))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert token_counts.token_counts(df.limit(0), BYTE_JSON).collect() == []


def test_round_trip_table(spark, library):
    df = frame(spark)
    wanted = []
    for row in df.collect():
        text = row["text"] or ""
        ids = library.encode_ordinary(text)
        wanted.append(
            (row["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        )
    assert sorted(map(tuple, byte_bpe.round_trip(df, RANKS, PATTERN).collect()), key=str) == sorted(wanted, key=str)
    decoded = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r["bytes"]).decode() for r in decoded.collect()) == sorted(r["text"] or "" for r in df.collect())
    assert byte_bpe.round_trip(df.limit(0), RANKS, PATTERN).collect() == []
