"""Token counts of whole texts by a tokenizer of the `tokenizers` library.

Texts are cut at safe boundaries: before a space that follows a character that is no white space.
No token of a byte-level BPE with the usual pattern reaches over such a boundary, no alternative of
the pattern looks back over it, and the only one that looks ahead needs white space before it. The
distinct pieces of a batch are encoded in batches of about equal bytes and only their lengths stay; a
text's count is the sum over its pieces.

Null and empty texts have no tokens. Strings of special tokens are one token each, as the library does by
default. Repeated rows are counted alike, each once. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import by_bytes, ship

BATCH_BYTES = 8 << 20
ENCODED_BYTES = 1 << 20
KNOWN_PIECES = 1_000_000
_UNSAFE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=[^\s])(?= )")


def safe_pieces(text: str) -> list[str]:
    """The pieces of a text; joined they are the text.

    >>> safe_pieces("one two  three")
    ['one', ' two', '  three']
    """
    if _UNSAFE.search(text):
        return [x for x in _SAFE.split(text) if x]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def batches_by_bytes(pieces: Iterable[str], most: int) -> Iterator[list[str]]:
    """Lists of pieces with about `most` bytes each."""
    batch, total = [], 0
    for piece in pieces:
        batch.append(piece)
        total += len(piece)
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


class PieceCounter:
    """Counts tokens; remembers the counts of up to `KNOWN_PIECES` pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        pieces = safe_pieces(text)
        new = set(pieces).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN_PIECES:
                self.known.clear()
                new = set(pieces)
            for batch in batches_by_bytes(new, ENCODED_BYTES):
                encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                self.known.update(zip(batch, map(len, encoded)))
        return sum(map(self.known.__getitem__, pieces))


_counters: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of df.

    `tokenizer` is the path of the tokenizer's file on every machine.
    """
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = [counter(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
