from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

WORD_JSON = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 7, 64, 100]))
def test_every_id_is_in_one_piece_and_sequences_have_no_gaps(lengths, length):
    documents, sequences = defaultdict(list), defaultdict(list)
    for document, start, n, sequence, offset in packing.pack(lengths, length):
        documents[document].append((start, n))
        sequences[sequence].append((offset, n))
    for pieces in (*documents.values(), *sequences.values()):
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
    assert {d: sum(n for _, n in p) for d, p in documents.items()} == dict(enumerate(lengths))
    used = [sum(n for _, n in p) for p in sequences.values()]
    assert all(n == length or (n < length and n & (n - 1) == 0) for n in used)
    assert sum(n != length for n in used) <= length.bit_length()


def test_documents_of_one_group_are_balanced_by_cost():
    pieces = packing.pack([50] * 20 + [5] * 200, 100)
    cost = defaultdict(float)
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += packing.cost(n, 100)
    assert max(cost.values()) < 1.3 * min(cost.values())


def test_pieces_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 500)
    tokenizer = Tokenizer.from_file(WORD_JSON)
    rows = [(i, "Some words, number %d. " % i * (i % 17) * 3, "x") for i in range(80)] + [(80, None, ""), (81, "", ""), (81, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    found = packing.pack_documents(df, WORD_JSON, 2, length=128).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        by_document[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, _ in rows[:81]:
        wanted = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert sum((ids for _, ids, _ in sorted(by_document[i])), []) == wanted
        assert {n for _, _, n in by_document[i]} == {len(wanted)}
    assert len(by_document[81]) == 2
    for pieces in by_sequence.values():
        assert sorted(pieces)[0][0] == 0 and sum(n for _, n in pieces) == max(o + n for o, n in pieces) <= 128
    assert packing.pack_documents(df.limit(0), WORD_JSON, 2).collect() == []


ODD_WORDS = (
    "Ab. AB ab a<|endoftext|>b x<|endoftext|>. it's don'T x'. café. éré,%%% a9. 9. x_ _a_ “x” x…. x . x\x1cy İstanbul. xक़. "
    "ΣΑΣ ﬁ. x² Ⅷ 한. 中文, \U0001f642. a‍b ẞ. á. ไทย. कि. ... <| |>"
).split(" ")


def test_ids_of_odd_words_are_the_librarys():
    tokenizer, encoder = Tokenizer.from_file(WORD_JSON), packing.WordEncoder(WORD_JSON, known_words=20)
    texts = [*ODD_WORDS, " ".join(ODD_WORDS), "\t".join(reversed(ODD_WORDS))]
    wanted = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert encoder([x.encode() for x in texts]) == wanted
    assert [encoder([x.encode()])[0] for x in texts] == wanted


def test_words_of_letters_are_encoded_together_and_once():
    encoder, texts = packing.WordEncoder(WORD_JSON), []

    class Counted:
        def encode_batch_fast(self, batch, add_special_tokens):
            texts.extend(batch)
            return tokenizer.encode_batch_fast(batch, add_special_tokens=add_special_tokens)

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counted()
    stems = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(2000)]
    words = [f(x) for x in stems for f in (str, str.upper, str.title, "{}.".format, "{},%%%".format)]
    (found,) = encoder([" ".join(words).encode()])
    assert found == np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert len(texts) < 10 and sum(map(len, texts)) < 9000


def test_tasks_of_other_operators_forget_the_words():
    packing.word_encoder(WORD_JSON)([b"some words"])
    packing.keep_words_only()
    assert packing.word_encoder(WORD_JSON).known
    packing.give_back_memory()
    assert not packing._encoders


def test_tasks_of_packing_share_the_words(spark):
    def known(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.known) for x in packing._encoders.values())])], names=["n"])

    df = spark.createDataFrame([(1, "some words that tasks remember")], "doc_id long, text string").coalesce(1)
    packing.pack_documents(df, WORD_JSON, 2).collect()
    counts = spark.range(64).repartition(64).selectExpr("id AS n").mapInArrow(known, "n long").collect()
    assert max(r["n"] for r in counts) >= 5
