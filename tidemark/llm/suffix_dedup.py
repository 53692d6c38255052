"""Repeated byte strings across documents, from hashes of phrase sequences.

A byte is removed where a string of `length` bytes that also starts anywhere else covers it.

* Parsing. Texts are cut into phrases after every 8 bytes whose hash is 0 modulo `PHRASE` (prefix-free parsing), so equal strings
  are cut alike from their ninth byte on. A shard, the texts of one task, keeps the cuts and a hash per phrase. Suffixes start
  at phrases, one for some fifty bytes.
* Grouping. Suffixes are grouped across shards by a hash of their first phrase, then of their first `DEPTH` phrases; only those that
  share it with another one take part in the next round. No order of suffixes and no transform is built.
* Repeated intervals. The last round goes down to all phrases that lie within a string of `length` bytes. Strings whose block is
  single occur once. Where all of a block's suffixes have equal bytes up to the ends of the strings, all these are repeated.
  Else phrases before or after differ, and the strings at these ends, and only those, are compared.
* Ends. The strings of a stretch of starts have the same phrases inside, so they differ in the bytes before the first and after the
  last cut. A stretch goes to its block as one row with these bytes, about two phrases, and is unfolded into strings there, in the
  task. Where strings have no phrase inside, phrases a third as long take their place. Strings without one of these, and one of all
  equal ones in a task of blocks that are cut between tasks or have more than `BLOCK_ROWS` stretches, are compared as rows of hashes.

With `words`, a run of so many words (of `[^ \\t-\\r]`) that also starts anywhere else is removed as well, however few bytes it has. Runs
of `length` bytes are such strings anyway; those of fewer, few in most texts, are compared one by one.

A text that occurs more than once is repeated as a whole; it takes part once. Blocks and strings are compared across tasks by
range partitions of (hash, place), which cut what very many places share into pieces; only the runs at the pieces' ends are looked
at again. To the driver comes one bit set of fixed size, which spares most texts the join with the places.

Null texts are empty. Texts shorter than `length` (and of fewer than `words` words) have nothing to remove. Matches never cross documents. Rows that repeat an id are
documents of their own. Phrases and strings are known by 64-bit hashes. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, keep, release, rows_with_keys, ship
from tidemark.llm.jaccard import _SPACE, mix
from tidemark.llm.runs import in_key_order, sorted_runs, starts_of, whole_runs

BATCH_BYTES = 4 << 20
TRIGGER = 8
PHRASE = 48
DEPTH = 4
FINER = 3
BLOCK_ROWS = 1 << 12
GO_ROWS = 1 << 10
U64 = np.uint64
_BYTE = mix(np.arange(256, dtype=U64), 41)
_FACTOR = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_FACTOR), -1, 1 << 64))
KNOWN_POWERS = 1 << 18
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, n at least; only those for up to KNOWN_POWERS bytes, 4 MB, are remembered."""
    if _tables and n <= KNOWN_POWERS:
        return _tables[0]
    size = max(n, KNOWN_POWERS)
    with np.errstate(over="ignore"):
        found = tuple(np.concatenate((np.ones(1, U64), np.multiply.accumulate(np.full(size - 1, x)))) for x in (_FACTOR, _INVERSE))
    if size == KNOWN_POWERS:
        _tables.append(found)
    return found


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit items, from sums over its beginnings."""

    def __init__(self, items: np.ndarray):
        powers, self.inverse = _powers(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(items * powers[: len(items)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64), 42)


def cuts_of(data: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
    """Where phrases end and start: after every TRIGGER bytes with a hash of 0 modulo `phrase`."""
    if len(data) < TRIGGER:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        x, step, factor = _BYTE[data], 1, _FACTOR
        while step < TRIGGER:
            x, step, factor = x[:-step] * factor + x[step:], 2 * step, factor * factor
    return np.flatnonzero((x >> U64(20)) % U64(phrase) == 0) + TRIGGER


def pieces(n: int, cuts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of starts of strings within n bytes that have the same cuts inside: first and last start, and the
    numbers of the first and last cut inside."""
    last = n - length
    edges = np.concatenate(([0], cuts - TRIGGER + 1, cuts - length))
    low = np.unique(edges[(edges >= 0) & (edges <= last)])
    high = np.concatenate((low[1:] - 1, [last]))
    return low, high, np.searchsorted(cuts, low + TRIGGER), np.searchsorted(cuts, low + length, side="right") - 1


def _with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("k"))


def _parsed(docs: DataFrame, length: int, phrase: int) -> DataFrame:
    """k, n (bytes), cuts, phrases and bare (some string has no phrase inside) of the texts of at least `length` bytes, each
    once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if len(text) < length or k in had:
                    continue
                had.add(k)
                data = np.frombuffer(text, np.uint8)
                cuts = cuts_of(data, phrase)
                phrases = Hashes(_BYTE[data]).of(cuts[:-1], cuts[1:]) if len(cuts) > 1 else np.empty(0, U64)
                _, _, i, j = pieces(len(text), cuts, length)
                rows.append((k, len(text), cuts.astype("<i4").tobytes(), phrases.tobytes(), bool((j <= i).any())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            names = ["k", "n", "cuts", "phrases", "bare"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    return docs.select("k", "text").mapInArrow(run, "k long, n long, cuts binary, phrases binary, bare boolean")


def _shared(blocks: DataFrame) -> DataFrame:
    """The places (k, at) of the blocks that more than one place has; blocks at the ends of a task's range stay too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(columns: dict, first: bool, last: bool) -> pa.RecordBatch:
            block, k, at = columns["block"], columns["k"], columns["at"]
            fresh = np.concatenate(([True], (block[1:] != block[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1])))
            block, k, at = block[fresh], k[fresh], at[fresh]
            starts = starts_of(block)
            sizes = np.diff(np.append(starts, len(block)))
            good = sizes > 1
            good[0] |= first
            good[-1] |= last
            good = np.repeat(good, sizes)
            return pa.RecordBatch.from_arrays([pa.array(k[good]), pa.array(at[good])], names=["k", "at"])

        yield from sorted_runs(batches, "block", handle)

    return in_key_order(blocks, "block", "k", "at").mapInArrow(run, "k long, at int")


def _blocks(texts: DataFrame, depth: int) -> DataFrame:
    """block, k and at: the suffixes of the texts (k, phrases and, after the first round, one: those with a shared first phrase) with
    their first `depth` phrases, if these are all shared."""
    marked = "one" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, places = [], [], []
            shared = batch.column("one").to_pylist() if marked else [None] * batch.num_rows
            for k, phrases, one in zip(batch.column("k").to_pylist(), batch.column("phrases").to_pylist(), shared):
                hashes = np.frombuffer(phrases, U64)
                counts = _counts(one, len(hashes)) if marked else np.arange(len(hashes) + 1)
                at = np.arange(max(len(hashes) - depth + 1, 0))
                at = at[counts[at + depth] - counts[at] == depth]
                keys.append(Hashes(hashes).of(at, at + depth).view(np.int64))
                names.append(np.full(len(at), k, np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names, places)], names=["block", "k", "at"])

    return texts.select("k", "phrases", *["one"] * marked).mapInArrow(run, "block long, k long, at int")


def _counts(places: list[int] | None, n: int) -> np.ndarray:
    """For every beginning of n suffixes, how many of them are listed."""
    listed = np.zeros(n + 1, np.int64)
    if places:
        listed[np.array(places) + 1] = 1
    return np.cumsum(listed)


def _last_round(texts: DataFrame, length: int) -> DataFrame:
    """block, whole, k, low and high: stretches of starts that the rounds before leave open, the hash of the phrases inside
    the strings, and the hash of all phrases from before the first string to after the last one (0 at a text's ends).

    A string with fewer than `DEPTH` phrases inside is open if all of them are shared, one with more if every block of `DEPTH`
    is; one without phrases always is, and its block is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = ("k", "n", "cuts", "phrases", "one", "more")
            for k, n, cuts, phrases, one, more in zip(*(batch.column(x).to_pylist() for x in names)):
                cuts, hashes = np.frombuffer(cuts, "<i4").astype(np.int64), np.frombuffer(phrases, U64)
                ones, mores = _counts(one, len(hashes)), _counts(more, len(hashes))
                low, high, i, j = pieces(n, cuts, length)
                inside = j > i
                few, many = inside & (j - i < DEPTH), j - i >= DEPTH
                good = ~inside
                good[few] = ones[j[few]] - ones[i[few]] == (j - i)[few]
                good[many] = mores[j[many] - DEPTH + 1] - mores[i[many]] == (j - i)[many] - DEPTH + 1
                low, high, i, j, inside = low[good], high[good], i[good], j[good], inside[good]
                sequence = Hashes(hashes)
                block, whole = np.zeros(len(low), U64), np.zeros(len(low), U64)
                block[inside] = sequence.of(i[inside], j[inside]) | U64(1)
                # from the cut at or before the first start to the one at or after the last end
                a, b = np.searchsorted(cuts, low, side="right") - 1, np.searchsorted(cuts, high + length)
                wide = inside & (a >= 0) & (b < len(cuts))
                a, b, i = a[wide], b[wide], i[wide]
                shape = (cuts[i] - low[wide]) << 40 | (high - low)[wide] << 20 | (i - a)
                with np.errstate(over="ignore"):
                    whole[wide] = mix(sequence.of(a, b) + mix(shape.astype(U64), 43), 44) | U64(1)
                out.append((block.view(np.int64), whole.view(np.int64), np.full(len(low), k, np.int64), low.astype(np.int32), high.astype(np.int32)))
            columns = [np.concatenate([x[c] for x in out]) for c in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["block", "whole", "k", "low", "high"])

    return texts.mapInArrow(run, "block long, whole long, k long, low int, high int")


def _verdicts(stretches: DataFrame) -> DataFrame:
    """k, low, high and sure: stretches of strings that are repeated for sure, and those to be compared one by one. Of equal
    stretches in a block that has others too, one is in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "whole", "k", "low", "high"]

        def handle(columns: dict, first: bool, last: bool) -> pa.RecordBatch:
            block, whole, k, low, high = (columns[x] for x in names)
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (low[1:] != low[:-1]) | (block[1:] != block[:-1])))
            block, whole, k, low, high = (x[fresh] for x in (block, whole, k, low, high))
            starts = starts_of(block)
            sizes = np.diff(np.append(starts, len(block)))
            cut = np.zeros(len(starts), np.bool_)
            cut[0] |= first
            cut[-1] |= last
            alike = np.minimum.reduceat(whole, starts) == np.maximum.reduceat(whole, starts)
            alike &= (whole[starts] != 0) & ~cut
            # equal from end to end: repeated for sure, and one of them stands for all where the block has others
            part = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (whole[1:] != whole[:-1]))))
            equal = np.repeat(np.diff(np.append(part, len(block))), np.diff(np.append(part, len(block))))
            sure = (equal > 1) & (whole != 0)
            stands = ~sure
            stands[part] = True
            doubt = np.repeat(~alike & ((sizes > 1) | cut), sizes) & stands
            chosen = np.concatenate((np.flatnonzero(sure), np.flatnonzero(doubt)))
            told = np.arange(len(chosen)) < sure.sum()
            columns = (k[chosen], low[chosen], high[chosen], told)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k", "low", "high", "sure"])

        yield from sorted_runs(batches, "block", handle)

    # strings without a phrase inside are compared one by one in any case
    ranged = in_key_order(stretches.filter("block <> 0"), "block", "whole", "k", "low")
    free = stretches.filter("block = 0").select("k", "low", "high", F.lit(False).alias("sure"))
    return ranged.mapInArrow(run, "k long, low int, high int, sure boolean").unionByName(free)


def _split(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stretches that don't overlap, cut before each place in `at`."""
    if not len(low):
        return low, high
    of = np.searchsorted(low, at, side="right") - 1
    starts = np.unique(np.concatenate((low, at[(of >= 0) & (at <= high[of])])))
    last = high[np.searchsorted(low, starts, side="right") - 1]
    return starts, np.minimum(np.append(starts[1:] - 1, last[-1]), last)


def _ends(texts: DataFrame, length: int, phrase: int) -> DataFrame:
    """block, k, low, high, gap and ends of the stretches of each text: the hash of the bytes from the first to the last cut inside
    the strings, the bytes from the first start to the first cut, and all bytes outside the cuts.

    Stretches without a phrase inside are cut anew into finer phrases. Strings without one of these are rows of their own (low = high),
    with the whole string's hash and no ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "k", "low", "high", "gap", "ends"]
        for batch in batches:
            for row in range(batch.num_rows):
                k, text = batch.column("k")[row].as_py(), batch.column("text")[row].as_py().encode()
                data = np.frombuffer(text, np.uint8)
                spans = batch.column("spans")[row].values
                low, high = (spans.field(x).to_numpy().astype(np.int64) for x in ("low", "high"))
                order = np.argsort(low)
                low, high, hashes = low[order], high[order], Hashes(_BYTE[data])
                for finer in (1, FINER):
                    cuts = cuts_of(data, max(phrase // finer, 1))
                    if finer > 1:
                        low, high = _split(low, high, pieces(len(text), cuts, length)[0])
                    i, j = np.searchsorted(cuts, low + TRIGGER), np.searchsorted(cuts, low + length, side="right") - 1
                    inside = j > i
                    starts, stops = low[inside], high[inside]
                    a, b = cuts[i[inside]], cuts[j[inside]]
                    block = hashes.of(a, b).view(np.int64)
                    gap = (a - starts).astype(np.int32)
                    for at in range(0, len(starts), 1 << 13):
                        part = slice(at, at + (1 << 13))
                        ends = [text[s:x] + text[y : e + length] for s, x, y, e in zip(*(v[part].tolist() for v in (starts, a, b, stops)))]
                        columns = (block[part], np.full(len(ends), k), starts[part].astype(np.int32), stops[part].astype(np.int32), gap[part])
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(ends, pa.binary())], names=names)
                    low, high = low[~inside], high[~inside]
                n = high - low + 1
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                block = hashes.of(at, at + length).view(np.int64)
                for start in range(0, len(at), 1 << 18):
                    some = at[start : start + (1 << 18)].astype(np.int32)
                    columns = (block[start : start + len(some)], np.full(len(some), k), some, some, np.zeros(len(some), np.int32))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.nulls(len(some), pa.binary())], names=names)

    return texts.mapInArrow(run, "block long, k long, low int, high int, gap int, ends binary")


def _unfolded(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of some stretches: the stretch's number, the start's distance from the stretch's first, and a hash by which equal
    strings, and only these, are known in every task."""
    block, low, high, gap, ends = (columns[x] for x in ("block", "low", "high", "gap", "ends"))
    sizes = np.fromiter(map(len, ends), np.int64, len(ends))
    n = high.astype(np.int64) - low + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[row] + offset
    hashes = Hashes(_BYTE[np.frombuffer(b"".join(ends), np.uint8)]).of(start, start + (sizes - n + 1)[row])
    with np.errstate(over="ignore"):
        inside = mix(block.view(U64)[row] + (gap[row] - offset).astype(U64) * _FACTOR, 45)
        return row, offset, mix(hashes + inside, 46)


def _settled(stretches: DataFrame) -> DataFrame:
    """block, k, low, high and open, from _ends: starts of repeated strings; and, marked open, the hash (block) and a start of each distinct
    string of blocks that this task mayn't have as a whole, or that are too long for one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray, is_open: bool) -> pa.RecordBatch:
            columns = (block.view(np.int64), k, low.astype(np.int32), high.astype(np.int32), np.full(len(k), is_open))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["block", "k", "low", "high", "open"])

        def groups(rows: np.ndarray, block: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
            """About GO_ROWS rows at a time, of whole blocks if asked for."""
            starts = starts_of(block[rows]) if whole and len(rows) else np.arange(len(rows))
            edges = np.unique(starts[np.minimum(np.searchsorted(starts, np.arange(0, len(rows), GO_ROWS)), len(starts) - 1)])
            for low, high in zip(edges, np.append(edges[1:], len(rows))):
                yield rows[low:high]

        for columns, first, last in whole_runs(batches, "block"):
            block, k, low = columns["block"], columns["k"], columns["low"]
            fresh = np.concatenate(([True], (block[1:] != block[:-1]) | (k[1:] != k[:-1]) | (low[1:] != low[:-1])))
            columns = {name: x[fresh] for name, x in columns.items()}
            block = columns["block"]
            sizes = np.diff(np.append(starts_of(block), len(block)))
            late = sizes > BLOCK_ROWS
            late[0] |= first
            late[-1] |= last
            for is_late, chosen in ((True, late), (False, ~late & (sizes > 1))):
                for rows in groups(np.flatnonzero(np.repeat(chosen, sizes)), block, not is_late):
                    some = {name: x[rows] for name, x in columns.items()}
                    row, offset, name = _unfolded(some)
                    k, at = some["k"][row], some["low"][row] + offset
                    order = np.argsort(name, kind="stable")
                    alike = name[order][1:] == name[order][:-1]
                    again = np.zeros(len(name), np.bool_)
                    again[order[1:][alike]] = again[order[:-1][alike]] = True
                    new = offset == 0
                    starts = np.flatnonzero(again & (new | ~np.append(False, again[:-1])))
                    ends = np.flatnonzero(again & np.append(new[1:] | ~again[1:], True))
                    yield told(np.zeros(len(starts), np.int64), k[starts], at[starts], at[ends], False)
                    if is_late:
                        # one of equal strings is enough to tell the other tasks
                        one = order[np.append(True, ~alike)]
                        yield told(name[one], k[one], at[one], at[one], True)

    return in_key_order(stretches, "block", "k", "low").mapInArrow(run, "block long, k long, low int, high int, open boolean")


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    letter = np.concatenate(([False], ~_SPACE[data], [False]))
    return np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])


def _short_runs(docs: DataFrame, words: int, length: int) -> DataFrame:
    """block (the run's hash), k and at (~ of its start, so below 0) of the runs of `words` words with fewer than `length` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                starts, ends = words_of(data)
                starts, ends = starts[: max(len(starts) - words + 1, 0)], ends[words - 1 :]
                short = ends - starts < length
                if not short.any():
                    continue
                starts, ends = starts[short], ends[short]
                block = Hashes(_BYTE[data]).of(starts, ends).view(np.int64)
                columns = (block, np.full(len(starts), k, np.int64), ~starts.astype(np.int32))
                for start in range(0, len(starts), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[start : start + (1 << 18)]) for x in columns], names=["block", "k", "at"])

    return docs.select("k", "text").mapInArrow(run, "block long, k long, at int")


def _runs_of_strings(strings: DataFrame) -> DataFrame:
    """block, k, at, many and cut: the places of strings that start at more than one place of a task's range; and, marked cut, those at
    the ends of the range, of which this isn't known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(columns: dict, first: bool, last: bool) -> pa.RecordBatch:
            block, k, at = columns["block"], columns["k"], columns["at"]
            fresh = np.concatenate(([True], (block[1:] != block[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1])))
            block, k, at = block[fresh], k[fresh], at[fresh]
            starts = starts_of(block)
            sizes = np.diff(np.append(starts, len(block)))
            cut = np.zeros(len(starts), np.bool_)
            cut[0] |= first
            cut[-1] |= last
            # of a cut run one place is enough to tell the other pieces of it
            seen = cut.copy()
            seen_at = np.zeros(len(block), np.bool_)
            seen_at[starts[seen]] = True
            many = np.repeat(sizes > 1, sizes)
            good = many | seen_at
            columns = (block[good], k[good], at[good], many[good], seen_at[good])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["block", "k", "at", "many", "cut"])

        yield from sorted_runs(batches, "block", handle)

    return in_key_order(strings, "block", "k", "at").mapInArrow(run, "block long, k long, at int, many boolean, cut boolean")


def _repeated(found: DataFrame) -> DataFrame:
    """k, low and high: starts of the strings that start at more than one place, neighbouring ones apart, from _runs_of_strings."""
    again = found.filter("cut").groupBy("block").agg(F.countDistinct("k", "at").alias("places")).filter("places > 1")
    # a run of one at an end whose other piece is in the next task
    late = found.filter("cut AND NOT many").join(again, "block", "left_semi")
    return found.filter("many").unionByName(late).select("k", F.col("at").alias("low"), F.col("at").alias("high"))


def repeated_spans(docs: DataFrame, length: int, phrase: int = PHRASE, words: int | None = None) -> DataFrame:
    """k and spans (arrays of low and high): starts of repeated strings of the texts that have any, and ~ of the starts of short
    runs of `words` words; docs has text and k."""
    texts = keep(_parsed(docs, length, phrase), "suffix")
    # copies of a text in several tasks are one place
    one = _shared(_blocks(texts, 1)).groupBy("k").agg(F.collect_set("at").alias("one"))
    living = keep(texts.dropDuplicates(["k"]).join(one, "k", "left").filter("one IS NOT NULL OR bare"), "suffix")
    release(texts)
    more = _shared(_blocks(living, DEPTH)).groupBy("k").agg(F.collect_set("at").alias("more"))
    stretches = keep(_last_round(living.join(more, "k", "left"), length), "suffix")
    release(living)
    verdicts = keep(_verdicts(stretches), "suffix")
    release(stretches)
    doubt = keep(verdicts.filter("NOT sure").groupBy("k").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "suffix")
    asked = rows_with_keys(docs.select("k", "text"), F.col("k"), doubt.select("k")).dropDuplicates(["k"]).join(doubt, "k")
    ends = keep(_ends(asked, length, phrase), "suffix")
    release(doubt)
    settled = keep(_settled(ends.filter("ends IS NOT NULL")), "suffix")
    strings = ends.filter("ends IS NULL").unionByName(settled.filter("open"), allowMissingColumns=True).select("block", "k", F.col("low").alias("at"))
    if words:
        strings = strings.unionByName(_short_runs(docs, words, length))
    strings = keep(strings, "suffix")
    release(ends)
    held = keep(_runs_of_strings(strings), "suffix")
    release(strings)
    found = verdicts.filter("sure").unionByName(settled.filter("NOT open"), allowMissingColumns=True).select("k", "low", "high")
    found = found.unionByName(_repeated(held))
    whole = keep(found.groupBy("k").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "suffix")
    for table in (verdicts, settled, held):
        release(table)
    return whole


def removed_spans(spans: list | np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of bytes that the strings cover, from their starts."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        end = high + length
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((low, end))
    return out


def kept(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in removed:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def _found(docs: DataFrame, length: int, phrase: int, words: int | None = None, as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The keys of texts that occur more than once, and for other texts with repeats: k, removed, n_spans, kept_sha and kept (binary;
    with `as_text` a string without the characters that a cut would split: a second function in the task would take Python
    workers of its own, which stay, with their memory, for as long as the executor does)."""
    long = F.octet_length("text") >= length
    if words:
        long |= F.when(F.octet_length("text") >= 2 * words - 1, F.regexp_count("text", F.lit(r"[^ \t-\r]+")) >= words)
    copies = docs.filter(long).select("k").groupBy("k").count()
    copies = keep(copies.filter("count > 1").select("k", F.lit(True).alias("whole")), "suffix")
    spans = keep(repeated_spans(docs, length, phrase, words).join(copies, "k", "left_anti"), "suffix")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode()
                found = batch.column("spans")[i].values
                low, high = (found.field(x).to_numpy().astype(np.int64) for x in ("low", "high"))
                runs = low < 0
                if runs.any():
                    low[runs] = ~low[runs]
                    starts, ends = words_of(np.frombuffer(text, np.uint8))
                    high[runs] = ends[np.searchsorted(starts, low[runs]) + words - 1] - length
                removed = removed_spans(list(zip(low.tolist(), high.tolist())), len(text), length)
                left = kept(text, removed)
                told = left.decode(errors="ignore") if as_text else left
                rows.append((batch.column("k")[i].as_py(), len(text) - len(left), len(removed), hashlib.sha256(left).hexdigest(), told))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            names = ["k", "removed", "n_spans", "kept_sha", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    texts = rows_with_keys(docs.select("k", "text"), F.col("k"), spans.select("k")).dropDuplicates(["k"]).join(spans, "k")
    return copies, texts.mapInArrow(cut, f"k long, removed long, n_spans long, kept_sha string, kept {'string' if as_text else 'binary'}")


def mark_repeats(
    df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE
) -> DataFrame:
    """id, k, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, null where nothing was removed) of every row."""
    if length <= TRIGGER:
        raise ValueError(f"length must be above {TRIGGER}")
    ship(df.sparkSession)
    docs = _with_key(df, id_col, text_col)
    copies, partly = _found(docs, length, phrase)
    narrow = docs.select("id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    nothing = hashlib.sha256(b"").hexdigest()
    joined = narrow.join(copies, "k", "left").join(partly, "k", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "k",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def remove_repeats(
    df: DataFrame, length: int = 400, text_col: str = "text", chars_col: str | None = None, phrase: int = PHRASE, words: int | None = None
) -> DataFrame:
    """df with its repeats removed from `text_col`; characters that a cut would split go too, null texts stay null.

    `chars_col` names a column that holds the number of characters, if there is one. With `words`, repeated runs of so many words
    go too where they have fewer than `length` bytes.
    """
    if length <= TRIGGER:
        raise ValueError(f"length must be above {TRIGGER}")
    ship(df.sparkSession)
    names = [f"c{i}" for i in range(len(df.columns))]
    text = names[df.columns.index(text_col)]
    rows = df.toDF(*names).withColumn("k", F.xxhash64(F.coalesce(text, F.lit(""))))
    copies, partly = _found(_with_key(df, text_col, text_col), length, phrase, words, as_text=True)
    cut = partly.select("k", F.col("kept").alias("left"))
    joined = rows.join(copies, "k", "left").join(cut, "k", "left")
    clean = F.when(F.col("whole"), "").when(F.col("left").isNotNull(), F.col("left")).otherwise(F.col(text))
    joined = joined.withColumn(text, clean)
    if chars_col is not None:
        chars = names[df.columns.index(chars_col)]
        changed = F.col("whole").isNotNull() | F.col("left").isNotNull()
        kind = df.schema[chars_col].dataType
        joined = joined.withColumn(chars, F.when(changed, F.length(text).cast(kind)).otherwise(F.col(chars)))
    return joined.select(*names).toDF(*df.columns)
