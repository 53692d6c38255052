"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of anything else become one space, and every text starts and ends with one. Its
n-grams of two and three characters are hashed to `buckets` columns. A model holds the log-probability of
every bucket in every language (counts plus `smoothing`) and the languages' log-priors. The fit takes a
bounded sample of the labelled rows, `sample_rows` at about, chosen by a hash of the id; its counts are summed
per task before they meet. The matrix is broadcast: languages times buckets numbers, and the languages are at
most `max_languages`, the most frequent ones in the sample. Every text is scored whole, in batches: the
counts of its buckets are a row of a sparse matrix (indices, counts and where rows begin), multiplied with the model in numpy
by segments of about `SEGMENT` entries.

Null texts and texts without letters are `und` with score 0. Without any labelled text every row is `und`.
Texts labelled null or without letters teach nothing. Ties go to the language that sorts first. Repeated rows
are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, give_back_memory, ship

# What a batch's n-grams and their counts take grows with it: 43 MB for 8 MB of text, 10 MB for 1 MB.
BATCH_BYTES = 1 << 20
SEGMENT = 1 << 15
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages, log-probabilities
    priors: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def ngrams(text: str, buckets: int) -> np.ndarray:
    """The hashed n-grams of a text, in order; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), np.bool_)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint32)
    if points[1] == 32:
        points = points[1:]
    if points[-2] == 32:
        points = points[:-1]
    two = points[:-1] * np.uint32(0x9E3779B1) ^ points[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ points[2:] * np.uint32(0x27D4EB2F) ^ np.uint32(0x165667B1)
    found = np.concatenate((two, three))
    found ^= found >> np.uint32(15)
    return (found * np.uint32(0x2C1B3C6D) >> np.uint32(8)).astype(np.int64) % buckets


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = 1 << 15,
    smoothing: float = 0.1,
    sample_rows: int = 20_000,
    max_languages: int = 256,
) -> Model:
    """Learn from the rows of df that have a text and a language."""
    ship(df.sparkSession)
    rows = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    n = df.select(df[lang_col].alias("lang")).filter("lang IS NOT NULL").count()
    if n > sample_rows:
        share = int(sample_rows / n * (1 << 30))
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        docs: dict[str, int] = {}
        counts: dict[str, np.ndarray] = {}
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = ngrams(text, buckets)
                if len(found):
                    docs[lang] = docs.get(lang, 0) + 1
                    if lang not in counts:
                        counts[lang] = np.zeros(buckets, np.int64)
                    counts[lang] += np.bincount(found, minlength=buckets)
        for lang, n_docs in docs.items():
            at = np.flatnonzero(counts[lang])
            at = np.concatenate(([-1], at))
            values = np.concatenate(([n_docs], counts[lang][at[1:]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.int64())],
                names=["lang", "bucket", "n"],
            )

    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = summed.filter("bucket = -1").orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    found = summed.join(F.broadcast(most), "lang", "left_semi").toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    table, docs = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    place = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    bucket, number = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    of_docs = bucket < 0
    docs[place[of_docs]] = number[of_docs]
    table[bucket[~of_docs], place[~of_docs]] = number[~of_docs]
    table += smoothing
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(table / table.sum(axis=0)), np.log(docs / max(docs.sum(), 1)))


def counted(found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets among some n-grams, and how often each occurs."""
    if len(found) < buckets:
        return np.unique(found, return_counts=True)
    counts = np.bincount(found, minlength=buckets)
    return np.flatnonzero(counts), counts[counts > 0]


def multiplied(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix, rows of buckets and counts (none empty), and the weights."""
    out, start = np.empty((len(rows), weights.shape[1])), 0
    while start < len(rows):
        end, entries = start, 0
        while end < len(rows) and (end == start or entries + len(rows[end][0]) <= SEGMENT):
            entries += len(rows[end][0])
            end += 1
        indices, counts = (np.concatenate([row[k] for row in rows[start:end]]) for k in (0, 1))
        begins = np.cumsum([0] + [len(row[0]) for row in rows[start : end - 1]])
        out[start:end] = np.add.reduceat(weights[indices] * counts[:, None], begins, axis=0)
        start = end
    return out


def score(model: Model, texts: list[str | None], buckets: int) -> tuple[list[str], np.ndarray]:
    """The most probable language of every text and its probability."""
    rows = [counted(ngrams(x, buckets) if x else np.empty(0, np.int64), buckets) for x in texts]
    langs, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = np.flatnonzero([len(x) for x, _ in rows])
    if len(at) and model.languages:
        sums = multiplied([rows[i] for i in at], model.weights) + model.priors
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(at)), best]
        sure[at] = 1 / np.exp(sums - top[:, None]).sum(axis=1)
        for i, k in zip(at, best):
            langs[i] = model.languages[k]
    return langs, sure


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row of df."""
    spark = df.sparkSession
    ship(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    buckets = len(model.weights)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        known = shared.value
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            langs, sure = score(known, batch.column("text").to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose language is found with at least `min_score`."""
    spark = df.sparkSession
    ship(spark)
    buckets, at = len(model.weights), df.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        known = shared.value
        for batch in by_bytes(batches, names[at], BATCH_BYTES):
            langs, sure = score(known, batch.column(at).to_pylist(), buckets)
            yield batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(langs, sure)], pa.bool_()))

    plain = df.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
