"""Packing of tokenized documents into sequences of a fixed length, balanced by estimated cost.

Every document ends with one more id, the separator. The ids of a group of documents (those of one task,
at most `GROUP_TOKENS` ids at a time) are packed together, so no document leaves its task:

* a document longer than a sequence fills whole sequences first; its rest goes on;
* a sequence of n ids of one document costs n + n * n / length: the linear layers and the attention;
* the group's rests are packed in descending order, each into the sequence of lowest cost with room for it;
  only when no sequence has room for the whole rest, it is cut at the sequence with the most room;
* the group has just as many sequences as its ids fill. What remains under one length is split into
  sequences whose lengths are powers of two, so no sequence needs padding.

Sequence ids are unique: the task's number in the upper bits, the sequence's in the lower ones. A document
with null or empty text is its separator alone. Repeated rows are packed as often as they occur. An empty
table has no pieces.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import by_bytes, give_back_memory, remembered, ship
from tidemark.llm.token_counts import batches_by_bytes

BATCH_BYTES = 2 << 20
GROUP_TOKENS = 1 << 20
# The encodings of a batch take some hundred times its bytes.
ENCODED_BYTES = 128 << 10
KNOWN_WORDS = 800_000


class WordEncoder:
    """Ids by a tokenizer that drops white space.

    No token of such a tokenizer reaches over ASCII white space, so a text's ids are those of its words in
    turn; the distinct words are encoded in batches and up to `known_words` of them remembered, some 200 bytes each.

    Where the tokenizer ends words with tokens of their own (`end_of_word_suffix`) and parts letters from ASCII punctuation,
    words of letters and punctuation at the end are these two parts. Words of letters alone, in lower case if the tokenizer
    makes them so, are encoded as one text, which its ending tokens part again. Other words, and those with letters that
    the tokenizer's normalizer turns into marks, are encoded one by one.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.known_words = known_words
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ending = np.zeros(max(vocab.values()) + 1, np.bool_)
        self.ending[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        letters = [ids(x) for x in ("x", "\u00e9")]
        self.normalized = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.one_text = all(len(x) and self.ending[x[-1]] for x in letters)
        # no tail may hold a part of a special string
        special = "".join(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        marks = [x for x in string.punctuation if x not in special and ids("x" + x) == letters[0] + ids(x) and ids("\u00e9" + x) == letters[1] + ids(x)]
        self.tails = "".join(marks).encode() if self.one_text else b""
        self.lowers = ids(string.ascii_uppercase) == ids(string.ascii_lowercase)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text (in UTF-8), as little-endian unsigned 32-bit integers."""
        cut = [text.split() for text in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.known_words:
                self.known = {}
                new = set().union(*cut)
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def _learn(self, words: set[bytes]) -> None:
        known, tails, parted, letters, others = self.known, self.tails, [], set(), set()
        for word in words:
            stem = word.rstrip(tails) if tails else word
            if stem.isalpha():
                stem = stem.lower() if self.lowers else stem
            elif not self.one_text or not self.normalized(stem.decode()).isalpha():
                others.add(word)
                continue
            if stem not in known:
                letters.add(stem)
            if stem != word:
                tail = word[len(stem) :]
                parted.append((word, stem, tail))
                if tail and tail not in known:
                    others.add(tail)
        for batch in batches_by_bytes(letters, ENCODED_BYTES):
            known.update(zip(batch, self._of_letters(batch)))
        for batch in batches_by_bytes(others, ENCODED_BYTES):
            known.update(zip(batch, self._one_by_one(batch)))
        known.update((word, known[stem] + known[tail] if tail else known[stem]) for word, stem, tail in parted)

    def _of_letters(self, words: list[bytes]) -> list[bytes]:
        if self.one_text:
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ending[ids]) + 1)
            # every word of letters has one ending at least
            if len(ends) == len(words):
                ends, ids = ends.tolist(), ids.tobytes()
                return [ids[start:end] for start, end in zip([0, *ends], ends)]
        return self._one_by_one(words)

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]


_encoders: dict[tuple[str, int], WordEncoder] = {}
remembered.append(_encoders)


def keep_words_only() -> None:
    """Give memory back but keep the encoders. A function of the module, as tasks would get a copy of a dictionary they name."""
    give_back_memory(keeping=_encoders)


def word_encoder(path: str, known_words: int = KNOWN_WORDS) -> WordEncoder:
    if (path, known_words) not in _encoders:
        _encoders[path, known_words] = WordEncoder(path, known_words)
    return _encoders[path, known_words]


def cost(tokens, length: int):
    """Estimated cost of one document's piece: linear layers plus attention within the piece."""
    return tokens + tokens * tokens / length


def pack(lengths: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given numbers of ids."""
    pieces, rests, sequence = [], [], 0
    for document, n in enumerate(lengths):
        whole = n // length
        for i in range(whole):
            pieces.append((document, i * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rests.append((n % length, document, whole * length))
    if not rests:
        return pieces
    total = sum(n for n, _, _ in rests)
    sizes = [length] * (total // length)
    sizes += [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if (total % length) >> bit & 1]
    free, costs, used = np.array(sizes), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)

    def put(document: int, start: int, n: int, at: int) -> None:
        pieces.append((document, start, n, sequence + at, int(used[at])))
        free[at] -= n
        used[at] += n
        costs[at] += cost(n, length) if free[at] else np.inf

    for n, document, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        while n:
            fits = np.where(free >= n, costs, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(free.argmax())
            part = min(n, int(free[at]))
            put(document, start, part, at)
            start, n = start + part, n - part
    return pieces


def pack_documents(
    df: DataFrame, tokenizer: str, separator: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian
    unsigned 32-bit). `tokenizer` is the path of the tokenizer's file on every machine."""
    if length < 1:
        raise ValueError("length must be at least 1")
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_words_only()
        encoder = word_encoder(tokenizer, known_words)
        base = TaskContext.get().partitionId() << 36
        names: list = []
        ids: list[bytes] = []
        waiting = 0

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal base, names, ids, waiting
            found = pack([len(x) // 4 for x in ids], length)
            for start in range(0, len(found), 4096):
                part = found[start : start + 4096]
                document, begin, n, sequence, offset = (np.array(x, np.int64) for x in zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in document], id_arrow),
                        pa.array(begin),
                        pa.array(n),
                        pa.array([len(ids[i]) // 4 for i in document], pa.int64()),
                        pa.array(base + sequence),
                        pa.array(offset),
                        pa.array([ids[i][4 * b : 4 * (b + k)] for i, b, k, _, _ in part], pa.binary()),
                    ],
                    names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            base += 1 + max((x[3] for x in found), default=-1)
            names, ids, waiting = [], [], 0

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            id_arrow = batch.column("id").type
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for name, tokens in zip(batch.column("id").to_pylist(), encoder(texts)):
                names.append(name)
                ids.append(tokens + end)
                waiting += len(ids[-1]) // 4
            if waiting >= GROUP_TOKENS:
                yield from group()
        if ids:
            yield from group()
        # the worker stays, for tasks of other kinds too
        keep_words_only()

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(
        run,
        f"`{id_col}` {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
