"""Exact clustering of integer vectors around centroids (Lloyd's rounds), with Shallot's search for the nearest centroid.

Vectors are multiplied by `scale` and rounded down. The first centroids are the vectors whose sha256 of
`<seed>:<id>` is smallest, in that order. A round assigns every vector to the nearest centroid and moves every
centroid that has vectors to their mean, rounded down by component; after `rounds` rounds vectors are assigned once more.

Every vector remembers its nearest and its second-nearest centroid, an upper bound of the distance to the first and a lower
bound of the distance to all others. Bounds follow the centroids' movements. Where they don't settle the matter (the
upper one is below the lower one or below half the gap between the centroid and its next neighbour), the distances to
both remembered centroids are taken, the scan starts from the closer one and visits the other centroids in the order of
their distance from it; it ends where that distance exceeds the distance to the start plus the second-best distance so
far, a ball that shrinks as better centroids are found. Bounds are doubles, widened by their rounding error, and
rule out only what is strictly farther; the centroids that survive are compared by squared distances in
integers, ties going to the smaller number.

The work is one scan per round: the table of vectors with what they remember is written to the shared folder and replaces
the one before. A task adds up its vectors per centroid before anything is shuffled, so a cluster that holds
most rows is one row per task. Centroids, as many numbers as clusters times components, are all that reaches the driver.

Vectors that are null, of another length than `width`, or hold null or non-finite components take no part. Repeated rows and
repeated ids are vectors of their own; a null id takes part and is the last choice for a first centroid. With fewer vectors than
`clusters` there are as many centroids as vectors. Components beyond what squared distances in 64 bits allow are an
error. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import keep, release, ship

# By how much bounds are widened to cover the rounding of doubles.
SLACK = 1e-9


def quantized(df: DataFrame, width: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of int) of the vectors that take part."""
    x = df[vector_col]
    largest = isqrt((1 << 61) // width) - 1
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    scaled = lambda e: F.floor(e.cast("double") * F.lit(float(scale)))
    within = lambda e: F.abs(e.cast("double") * F.lit(float(scale))) <= F.lit(float(min(largest, (1 << 31) - 1)))
    beyond = F.raise_error(F.lit("a squared distance may not fit into 64 bits; use a smaller scale")).cast("int")
    whole = F.transform(x, lambda e: F.when(within(e), scaled(e).cast("int")).otherwise(beyond))
    rows = df.filter(x.isNotNull()).filter((F.size(x) == width) & sound)
    return rows.select(df[id_col].alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes, in order: a top-k, so no more than that leaves a task."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.select(hashed.alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v").limit(clusters)
    return np.array([r["v"] for r in chosen.collect()], np.int64)


class Centroids:
    """Centroids with their neighbours by distance, and how far each has moved since the last round."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        gaps = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
        np.fill_diagonal(gaps, -1)  # itself comes first, and never ties with a centroid at the same place
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.maximum(np.take_along_axis(gaps, self.order, axis=1), 0)
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64))
        self.moved = moved
        ranked = np.argsort(-moved, kind="stable")
        self.farthest = np.full(len(at), moved[ranked[0]])
        if len(at) > 1:
            self.farthest[ranked[0]] = moved[ranked[1]]

    def squared(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The exact squared distance of every vector to a centroid of its own."""
        apart = x - self.at[number]
        return np.einsum("ij,ij->i", apart, apart)


def assign(x: np.ndarray, found: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The nearest and second-nearest centroid of every vector, and its two bounds, from those of the round before.

    Returns (first, second, upper, lower, compared): the last is how many exact distances were taken.
    """
    k, compared = len(found.at), 0
    if k == 1:
        return np.zeros_like(first), second, upper, np.full_like(lower, np.inf), 0
    first, second = first.copy(), second.copy()
    upper = (upper + found.moved[first]) * (1 + SLACK)
    lower = lower - found.farthest[first]
    lower -= SLACK * np.abs(lower)
    clear = np.maximum(lower, found.gaps[first, 1] / 2 * (1 - SLACK))
    open_ = np.flatnonzero(upper >= clear)
    if len(open_):
        exact = np.sqrt(found.squared(x[open_], first[open_]).astype(np.float64)) * (1 + SLACK)
        compared += len(open_)
        upper[open_] = exact
        open_ = open_[exact >= clear[open_]]
    if not len(open_):
        return first, second, upper, lower, compared
    own = x[open_]
    a, b = first[open_], second[open_]
    da, db = found.squared(own, a), found.squared(own, b)
    compared += len(open_)
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, from_start, other = a.copy(), np.sqrt(da.astype(np.float64)), b.copy()
    going = np.arange(len(open_))
    for place in range(1, k):
        reach = (from_start[going] + np.sqrt(db[going].astype(np.float64))) * (1 + SLACK)
        going = going[found.gaps[start[going], place] <= reach]
        if not len(going):
            break
        number = found.order[start[going], place]
        fresh = number != other[going]
        at, number = going[fresh], number[fresh]
        d = found.squared(own[at], number)
        compared += len(at)
        best = (d < da[at]) | ((d == da[at]) & (number < a[at]))
        next_best = ~best & ((d < db[at]) | ((d == db[at]) & (number < b[at])))
        to = at[best]
        b[to], db[to], a[to], da[to] = a[to], da[to], number[best], d[best]
        to = at[next_best]
        b[to], db[to] = number[next_best], d[next_best]
    first[open_], second[open_] = a, b
    upper[open_] = np.sqrt(da.astype(np.float64)) * (1 + SLACK)
    lower[open_] = np.sqrt(db.astype(np.float64)) * (1 - SLACK)
    return first, second, upper, lower, compared


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _assigned(rows: DataFrame, found: Centroids, width: int) -> DataFrame:
    """id, v, and what each vector remembers, after a search that starts from what it remembered before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, width)
            if "first" in batch.schema.names:
                known = [batch.column(c).to_numpy() for c in ("first", "second", "upper", "lower")]
            else:
                n, last = len(x), min(1, len(found.at) - 1)
                known = [np.zeros(n, np.int32), np.full(n, last, np.int32), np.full(n, np.inf), np.full(n, -np.inf)]
            first, second, upper, lower, _ = assign(x, found, *known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
                 pa.array(upper), pa.array(lower), pa.array(found.squared(x, first))],
                names=["id", "v", "first", "second", "upper", "lower", "distance"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, v array<int>, first int, second int, upper double, lower double, distance long"
    return rows.mapInArrow(run, schema)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to the means of their vectors; those without vectors stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            number = batch.column("first").to_numpy()
            x = _vectors(batch, width)
            for c in np.unique(number):
                own = number == c
                sums[c] += x[own].sum(axis=0)
                n[c] += own.sum()
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

    of_tasks = rows.select("v", "first").mapInArrow(run, "cluster int, n long, sums array<long>")
    # exact also where a total leaves 64 bits
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    moved = centroids.copy()
    for r in of_tasks.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums")).collect():
        moved[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    return moved


def clusters_of(
    df: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: float = 64, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster and squared distance of every vector, the final centroids)."""
    spark = df.sparkSession
    ship(spark)
    rows = quantized(df, width, scale, id_col, vector_col)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        id_type = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long"), centroids
    found = Centroids(centroids)
    held = keep(_assigned(rows, found, width), "clusters")
    for _ in range(rounds):
        found = Centroids(_means(held, found.at), found.at)
        before, held = held, keep(_assigned(held, found, width), "clusters")
        release(before)
    return held.select(F.col("id").alias(id_col), F.col("first").alias("cluster"), "distance"), found.at


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors of clusters_of, each with its cluster's and the whole inertia and a digest of its centroid."""
    spark = assigned.sparkSession
    texts = [(i, ",".join(map(str, map(int, row)))) for i, row in enumerate(centroids)]
    digests = spark.createDataFrame(texts, "cluster int, text string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row per cluster
    whole = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))
    about = sums.withColumn("inertia", whole).join(digests, "cluster")
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(about), "cluster")
