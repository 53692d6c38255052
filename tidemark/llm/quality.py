"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters, digits and characters beyond ASCII, lower-cased from A to Z, and runs of other visible ASCII
characters. Single words and pairs of neighbours are hashed to `buckets` columns; a column's value is log(1 + count),
and a text's values have length 1. One more column, always 1, is the bias.

The fit takes a bounded sample of labelled documents, `sample_rows` at about: labels are summed per id first and ids chosen
by hash, so what is broadcast is bounded however many labels there are; where an id stands for many texts, rows are chosen
once more by hash of id and text. The sparse rows are written once and dealt to lanes of about `lane_rows`. In every epoch each lane starts from the
shared state (two numbers a column) and takes its rows one by one, in the order of a hash; the state's changes are averaged over
the lanes. All that reaches the driver is one state. Scores are sparse dot products with the weights, over whole texts,
a batch of rows at once.

Labels other than 0 and 1 and null labels or ids teach nothing; an id with several labels counts by their majority, one with a tie not
at all; repeated rows of one id and text are one example. Null and empty texts have the bias alone, and texts labelled so teach it.
Without any example every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, keep, ship

BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
BLANK = re.compile(rb"[^!-~\x80-\xff]")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 0.0
    epochs: int = 5


def word_codes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the words of a text, in order, in pieces that end between words."""
    start = 0
    while start < len(text):
        blank = BLANK.search(text, start + PIECE_BYTES)
        end = blank.start() if blank else len(text)
        found = WORD.findall(text[start:end].lower())
        yield np.fromiter(map(crc32, found), np.uint32, len(found))
        start = end


def grams(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The columns of single words and then of neighbours."""
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    two ^= two >> np.uint32(15)
    return np.concatenate((codes, two * np.uint32(0x2C1B3C6D))).astype(np.int64) % buckets


def counted(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of one text, in order, and how often each occurs; a long text is counted piece by piece."""
    pieces, last, sums = word_codes(text), np.empty(0, np.uint32), None
    for codes in pieces:
        whole = grams(np.concatenate((last, codes)), buckets)
        if len(last):
            whole = whole[1:]  # the word carried over has been counted
        if len(text) <= PIECE_BYTES:
            return np.unique(whole, return_counts=True)
        sums = np.bincount(whole, minlength=buckets) if sums is None else sums + np.bincount(whole, minlength=buckets)
        last = codes[-1:] if len(codes) else last
    if sums is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(sums)
    return at, sums[at]


def sparse_rows(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, columns, values): a sparse matrix with a row per text, each of length 1 or empty, without the bias."""
    found = [counted(x or b"", buckets) for x in texts]
    sizes = np.array([len(x) for x, _ in found], np.int64)
    columns = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    values = np.log1p(np.concatenate([n for _, n in found])) if found else np.empty(0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    norm = np.sqrt(np.bincount(row, values * values, len(sizes)))
    return sizes, columns, values / norm[row]


def weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """What the leader is, given the sums of its gradients and of their squares."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def update(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: float, s: Settings) -> None:
    """Follow the regularised leader by one example; `at` has no column twice."""
    w = weights(z[at], n[at], s)
    gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
    squares = n[at] + gradient * gradient
    z[at] += gradient - (np.sqrt(squares) - np.sqrt(n[at])) / s.alpha * w
    n[at] = squares


def examples(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int
) -> DataFrame:
    """id, h (a hash of the text), text and label of a bounded sample of labelled rows, each once."""
    y = labels[label_col].cast("double")
    ids = labels.select(labels[id_col].alias("id"), y.alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    votes = ids.groupBy("id").agg(F.sum(2 * F.col("label") - 1).alias("votes")).filter("votes <> 0")
    votes = keep(votes.select("id", (F.col("votes") > 0).cast("double").alias("label")), "quality-labels")
    # about sample_rows ids, so small enough to be sent to every task
    chosen = F.broadcast(_thinned(votes, votes.count(), sample_rows, "id"))
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(chosen, "id").withColumn("h", F.xxhash64("text"))
    distinct = rows.select("id", "h").distinct().count()
    return _thinned(rows, distinct, sample_rows, "id", "h").groupBy("id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def _thinned(rows: DataFrame, n: int, wanted: int, *key: str) -> DataFrame:
    if n <= wanted:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    settings: Settings = Settings(), sample_rows: int = 20_000, lane_rows: int = 2500,
) -> np.ndarray:
    """The weights, one per column and the bias, from the rows of df that have a label."""
    spark = df.sparkSession
    ship(spark)
    buckets = settings.buckets

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sizes, columns, values = sparse_rows(batch.column("text").cast(pa.binary()).to_pylist(), buckets)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(columns.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(values))],
                names=["place", "label", "at", "x"],
            )

    chosen = examples(df, labels, id_col, text_col, label_col, sample_rows)
    placed = chosen.select(F.xxhash64(F.lit("order"), "id", "h").alias("place"), "label", "text")
    rows = keep(placed.mapInArrow(vectors, "place long, label double, at array<int>, x array<double>"), "quality")
    lanes = max(1, -(-rows.count() // lane_rows))
    rows = rows.withColumn("lane", F.pmod(F.col("place"), F.lit(lanes)).cast("int"))
    state = np.zeros((2, buckets + 1))

    def epoch(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = shared.value
            lane, held = None, start.copy()
            for batch in batches:
                for number, label, at, x in zip(
                    batch.column("lane").to_pylist(), batch.column("label").to_pylist(), batch.column("at"), batch.column("x")
                ):
                    if lane is not None and number != lane:
                        yield changes(held - start)
                        held = start.copy()
                    lane = number
                    columns = np.append(at.values.to_numpy(), buckets)
                    update(*held, columns, np.append(x.values.to_numpy(), 1.0), label, settings)
            if lane is not None:
                yield changes(held - start)

        def changes(moved: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(moved.any(axis=0))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1)), pa.array(np.append(moved[0, at], 1.0)), pa.array(np.append(moved[1, at], 1.0))],
                names=["at", "z", "n"],
            )

        dealt = rows.repartition(lanes, "lane").sortWithinPartitions("lane", "place")
        return dealt.mapInArrow(run, "at long, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))

    for _ in range(settings.epochs):
        shared = spark.sparkContext.broadcast(state)
        moved = epoch(shared).toPandas()
        at, change = moved["at"].to_numpy(np.int64), moved[["z", "n"]].to_numpy(np.float64).T
        if not len(at):
            break
        state = state.copy()
        state[:, at[at >= 0]] += change[:, at >= 0] / change[0, at < 0]
        shared.unpersist()
    return weights(*state, settings)


def score(df: DataFrame, learned: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score and predicted (1 from `threshold` on) of every row of df."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(learned)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sizes, columns, values = sparse_rows(batch.column("text").cast(pa.binary()).to_pylist(), len(w) - 1)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(row, values * w[columns], len(sizes)) + w[-1]
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[id_col, "score", "predicted"],
            )

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")
