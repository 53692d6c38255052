"""Byte-level BPE, encoding and decoding, in numpy.

A vocabulary is a file of ranks: a token's bytes in base64, a space, its rank, which is its id. A text is
cut by the pattern; every match is merged by itself. Matches of similar length form a padded matrix of token
ids, one row per match. In each round every row merges its leftmost pair of lowest rank; the ranks of
all neighbouring pairs come from a hash table in numpy arrays. Rows without a pair left leave the matrix,
and the rest is compacted. Matches of more than `MATRIX_BYTES` bytes are merged one by one with a heap, in
the same order.

Null and empty texts have no tokens; their ids and decoded bytes are empty. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import by_bytes, ship
from tidemark.llm.token_counts import safe_pieces

BATCH_BYTES = 8 << 20
MATRIX_BYTES = 512
MATRIX_CELLS = 1 << 20
KNOWN_PIECES = 800_000
NONE = np.int64(1) << 40


class PairTable:
    """Ids of merged pairs, found by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 2).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo][free], return_index=True)
            taken = todo[free][first]
            self.keys[slots], self.values[slots] = keys[taken], merged[taken]
            todo = np.setdiff1d(todo, taken)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of every merged pair, NONE where two tokens don't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, out = self._home(keys), np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return out


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)
        self.known: dict[str, bytes] = {}

    def merge_matrix(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of similar length, every word's as little-endian unsigned 32-bit integers."""
        width = max(map(len, words))
        lengths = np.array([len(x) for x in words])
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in words), np.uint8)
        ids = self.byte_ids[flat].reshape(len(words), width)
        columns = np.arange(width)
        ids[columns >= lengths[:, None]] = -1
        out = [b""] * len(words)
        rows = np.arange(len(words))
        ranks = self._ranks(ids)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            lowest = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = lowest == NONE
            if done.any():
                ready, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, (row, n) in enumerate(zip(rows[done].tolist(), lengths[done].tolist())):
                    out[row] = ready[i * step : i * step + 4 * n]
            if done.all():
                break
            left = ~done
            ids, ranks, rows, lengths = ids[left], ranks[left], rows[left], lengths[left]
            best, lowest = best[left], lowest[left]
            # close the gap that the merged token leaves
            width = ids.shape[1]
            source = np.arange(width - 1)
            source = source + (source > best[:, None])
            at = np.arange(len(rows))
            ids = np.take_along_axis(ids, source, axis=1)
            ids[at, best] = lowest
            lengths = lengths - 1
            width = int(lengths.max())
            gap = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, gap + (gap >= best[:, None]), axis=1)
            ids, ranks = ids[:, :width], ranks[:, : max(width - 1, 0)]
            for shift in (-1, 0):
                place = best + shift
                ok = (place >= 0) & (place + 1 < lengths)
                ranks[at[ok], place[ok]] = self.pairs.find(ids[at[ok], place[ok]], ids[at[ok], place[ok] + 1])
        return out

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1], ids[:, 1:]
        ranks = np.full(left.shape, NONE, np.int64)
        real = right >= 0
        ranks[real] = self.pairs.find(left[real], right[real])
        return ranks

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word, by a heap of pairs over a linked list."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(word, np.uint8)]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.ranks.get
        heap = []

        def offer(i: int) -> None:
            if after[i] < len(ids):
                rank = get(self.tokens[ids[i]] + self.tokens[ids[after[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of the distinct words; a word that is a token has its own id."""
        out, buckets = {}, {}
        for word in set(words):
            if word in self.ranks:
                out[word] = self.ranks[word].to_bytes(4, "little")
            elif len(word) > MATRIX_BYTES:
                out[word] = self.merge_long(word)
            else:
                buckets.setdefault((len(word) + 1) // 2 if len(word) < 32 else 16 + len(word).bit_length(), []).append(word)
        for bucket in buckets.values():
            rows = max(1, MATRIX_CELLS // max(map(len, bucket)))
            for start in range(0, len(bucket), rows):
                part = bucket[start : start + rows]
                out.update(zip(part, self.merge_matrix(part)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        cut = [safe_pieces(text) for text in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN_PIECES:
                self.known = {}
                new = set().union(*cut)
            gc.disable()  # nothing here is cyclic, and looking through so many small lists takes long
            matches = {piece: self.pattern.findall(piece) for piece in new}
            ids = self.encode_words(m.encode() for found in matches.values() for m in found)
            for piece, found in matches.items():
                whole = ids[found[0].encode()] if len(found) == 1 else b"".join(ids[m.encode()] for m in found)
                self.known[piece] = whole
            gc.enable()
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (binary, little-endian unsigned 32-bit) of every row of df.

    `ranks` is the path of the file of ranks on every machine.
    """
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, ids binary")


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and bytes (binary) of every row of df; null ids have null bytes, an unknown id is an error."""
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in by_bytes(batches, "ids", BATCH_BYTES):
            found = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=[id_col, "bytes"])

    narrow = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, bytes binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts encoded, ids decoded again."""
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
