"""Approximate nearest neighbours by inner product: NN-descent graphs and greedy graph search.

Vectors are divided by the largest norm and get one more component that makes all of them unit vectors, so the
largest inner products with a query are the nearest points on a sphere. Equal vectors are one node that keeps its smallest ids, as many
as a result can show. Nodes are dealt to shards of about `shard_rows` by a hash of the vector and numbered within.

* Building. Every node starts with the best of a few nodes near it along a random direction. Each round joins the table of neighbours
  with itself: a node's neighbours, and up to as many that list it, hand it their own neighbours, and it keeps the best `k` of all.
  Rounds end when less than `least_change` of the lists changes, or after `rounds`. All lists that are joined have at most 2k entries;
  a node that very many others list hands out k of them, chosen by hash.
* Searching. Blocks of queries meet shards by a key. All queries of a block walk the shard's graph together in numpy: each scores the
  entries, one in `ENTRY_EVERY` nodes and one more wherever nodes can't be reached from those, and opens its best nodes not yet opened,
  until none of its best `beam` is left. All of these are ranked by exact products of the original vectors in double
  precision, and the best of all shards by these.

Every row is indexed. The search is approximate: neighbours that no path of good nodes leads to from an entry are missed. In a shard of up to `beam`
nodes it is exact.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids, nor vectors of another length than
most have. A query's own id is no candidate; rows that repeat an id and its vector are one. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import keep, ship

SHARD_ROWS = 8192
BLOCK_ROWS = 256
NEIGHBOURS = 20
BEAM = 160
ROUNDS = 8
LEAST_CHANGE = 0.02
CELL = 96
DIRECTIONS = 2
OPENED = 6
ENTRIES = 32
ENTRY_EVERY = 8


def sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.transform(df[vector_col], lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(df[id_col].cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(fine)


def _nodes(rows: DataFrame, n_ids: int, shard_rows: int) -> tuple[DataFrame, int]:
    """shard, at, ids (the smallest n_ids) and v: one row per distinct vector; and the number of shards."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("place", place).filter(F.col("place") <= n_ids)
    nodes = keep(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann")
    n_shards = max(1, -(-nodes.count() // shard_rows))
    shard = F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int")
    number = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit("order"), "v"), "v")) - 1
    return keep(nodes.withColumn("shard", shard).withColumn("at", number), "ann"), n_shards


def unit(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors as points of a sphere."""
    v = v / largest
    rest = np.sqrt(np.maximum(1 - (v * v).sum(axis=1), 0))
    return np.concatenate((v, rest[:, None]), axis=1).astype(np.float32)


def best_of(points: np.ndarray, at: np.ndarray, candidates: list[np.ndarray], k: int) -> list[np.ndarray]:
    """For each place in `at` its k best distinct candidates, best first."""
    out = []
    for i, found in zip(at, candidates):
        found = np.unique(found)
        found = found[found != i]
        score = points[found] @ points[i]
        if len(found) > k:
            top = np.argpartition(score, -k)[-k:]
            found, score = found[top], score[top]
        out.append(found[np.argsort(-score, kind="stable")].astype(np.int32))
    return out


def build(nodes: DataFrame, largest: float, k: int, rounds: int, least_change: float) -> DataFrame:
    """shard, at and near (array of places in the shard): the neighbour graph of all nodes."""
    points = nodes.select("shard", "at", "v")

    def start(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        own = unit(np.stack(group["v"].to_numpy()), largest)
        found: list[list[np.ndarray]] = [[] for _ in range(len(own))]
        for seed in range(DIRECTIONS):
            order = np.argsort(own @ np.random.default_rng(seed).standard_normal(own.shape[1]), kind="stable")
            for low in range(0, len(order), CELL):
                cell = order[max(0, min(low, len(order) - CELL)) :][:CELL]
                for i in order[low : low + CELL]:
                    found[i].append(cell)
        near = best_of(own, np.arange(len(own)), [np.concatenate(x) for x in found], k)
        return pd.DataFrame({"shard": group["shard"].to_numpy(), "at": group["at"].to_numpy(), "near": near, "changed": [len(x) for x in near]})

    def improve(lists: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        own = unit(np.stack(group["v"].to_numpy()), largest)
        before = dict(zip(lists["at"][lists["own"]], lists["near"][lists["own"]]))
        heard: dict[int, list[np.ndarray]] = {i: [x] for i, x in before.items()}
        for i, near in zip(lists["at"][~lists["own"]], lists["near"][~lists["own"]]):
            heard[i].append(near)
        at = np.array(sorted(heard), np.int64)
        near = best_of(own, at, [np.concatenate(heard[i]) for i in at], k)
        changed = [len(np.setdiff1d(x, before[i])) for i, x in zip(at, near)]
        return pd.DataFrame({"shard": group["shard"].iloc[0], "at": at, "near": near, "changed": changed})

    out = "shard int, at int, near array<int>, changed int"
    graph = keep(points.groupBy("shard").applyInPandas(start, out), "ann")
    for _ in range(rounds):
        both = joined_lists(graph, k)
        pairs = both.select("shard", "at", F.explode("near").alias("to"))
        # each neighbour of a node tells it its own neighbours
        told = pairs.join(both.select("shard", F.col("at").alias("to"), "near"), ["shard", "to"])
        lists = told.select("shard", "at", "near", F.lit(False).alias("own"))
        lists = lists.unionByName(graph.select("shard", "at", "near", F.lit(True).alias("own")))
        graph = keep(lists.groupBy("shard").cogroup(points.groupBy("shard")).applyInPandas(improve, out), "ann")
        changed = graph.agg(F.sum("changed"), F.sum(F.size("near"))).first()
        if not changed[1] or changed[0] < least_change * changed[1]:
            break
    return graph.select("shard", "at", "near")


def joined_lists(graph: DataFrame, k: int) -> DataFrame:
    """shard, at and near: the neighbours of every node and up to k of those that list it."""
    forth = graph.select("shard", "at", F.explode("near").alias("to"))
    back = forth.select("shard", F.col("to").alias("at"), F.col("at").alias("to"))
    place = F.row_number().over(Window.partitionBy("shard", "at").orderBy(F.xxhash64("at", "to"), "to"))
    back = back.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    return forth.unionByName(back).groupBy("shard", "at").agg(F.collect_set("to").alias("near"))


def entries_of(near: np.ndarray, beam: int) -> np.ndarray:
    """Places where walks start: some all over the shard, in number growing with it, and one in each part of the graph that these don't
    lead to. All of a shard of up to `beam` nodes."""
    n = len(near)
    if n <= beam:
        return np.arange(n)
    entries = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, n // ENTRY_EVERY))).astype(np.int64))
    reached = np.zeros(n + 1, np.bool_)
    reached[n] = True  # stands for -1
    new, more, at = entries, [], 0
    while True:
        reached[new] = True
        while len(new):
            found = np.unique(near[new])
            new = found[~reached[found]]
            reached[new] = True
        while at < n and reached[at]:
            at += 1
        if at == n:
            return np.concatenate((entries, np.array(more, np.int64)))
        more.append(at)
        new = np.array([at])


def walk(points: np.ndarray, near: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best `beam` points each query finds (place -1 where there are fewer).

    `near` has a row of neighbours per point, filled up with -1.
    """
    n, m, rows = len(points), len(queries), np.arange(len(queries))[:, None]
    entries = entries_of(near, beam)
    seen = np.zeros((m, n + 1), np.bool_)
    seen[:, n] = True  # stands for -1
    seen[:, entries] = True
    place = np.tile(entries, (m, 1))
    score = queries @ points[entries].T
    opened = np.zeros(place.shape, np.bool_)
    while True:
        if place.shape[1] > beam:
            top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            place, score, opened = (np.take_along_axis(x, top, axis=1) for x in (place, score, opened))
        waiting = np.where(opened, -np.inf, score)
        width = min(OPENED, waiting.shape[1])
        pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        live = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        if not live.any():
            order = np.argsort(-score, axis=1, kind="stable")
            return np.take_along_axis(place, order, axis=1), np.take_along_axis(score, order, axis=1)
        np.put_along_axis(opened, pick, True, axis=1)
        found = near[np.where(live, np.take_along_axis(place, pick, axis=1), -1)].reshape(m, -1)
        found = np.sort(np.where(found < 0, n, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        found[seen[rows, found]] = n
        found = np.sort(found, axis=1)
        found = found[:, : max(1, int((found < n).sum(axis=1).max()))]
        seen[rows, found] = True
        real = found < n
        scores = np.full(found.shape, -np.inf, np.float32)
        at = np.nonzero(real)
        scores[at] = np.einsum("ij,ij->i", points[found[at]], queries[at[0]])
        place = np.concatenate((place, np.where(real, found, -1)), axis=1)
        score = np.concatenate((score, scores), axis=1)
        opened = np.concatenate((opened, ~real), axis=1)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, largest: float, n_shards: int, top: int, k: int, beam: int) -> DataFrame:
    """query_id, id and score: the best `top` rows per query and shard."""
    links = joined_lists(graph, k)
    rows = nodes.join(links, ["shard", "at"], "left").select("shard", F.struct("at", "ids", "v", "near").alias("node"))
    packed = keep(rows.groupBy("shard").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "ann")
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(n_blocks))
    asked = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    blocks = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, asked = batch.column("nodes")[i].values, batch.column("asked")[i].values
                vectors = own.field("v").flatten().to_numpy().reshape(len(own), -1)
                near = np.full((len(own), 2 * k), -1, np.int64)
                lists = own.field("near")
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                near[np.arange(2 * k) < sizes[:, None]] = lists.flatten().to_numpy()
                ids = own.field("ids").to_pylist()
                names = asked.field("id").to_pylist()
                original = asked.field("v").flatten().to_numpy().reshape(len(names), -1)
                toward = original / np.linalg.norm(original, axis=1)[:, None]
                toward = np.concatenate((toward, np.zeros((len(names), 1))), axis=1).astype(np.float32)
                places, _ = walk(unit(vectors, largest), near, toward, beam)
                out = []
                for q, name in enumerate(names):
                    found = places[q][places[q] >= 0]
                    scores = vectors[found] @ original[q]
                    if len(found) > top + 1:  # the query's own node may be among them; ties stay
                        best = scores >= np.partition(scores, -top - 1)[-top - 1]
                        found, scores = found[best], scores[best]
                    rows = [(-s, x) for s, at in zip(scores.tolist(), found) for x in ids[at] if x != name]
                    out += [(name, x, -s) for s, x in sorted(rows)[:top]]
                columns = list(zip(*out)) if out else [[], [], []]
                types = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["query_id", "id", "score"])

    return blocks.join(packed, "shard").mapInArrow(run, "query_id long, id long, score double")


def nearest(
    df: DataFrame, queries: DataFrame, top: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
    beam: int = BEAM, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS, least_change: float = LEAST_CHANGE,
) -> DataFrame:
    """query_id, rank, id_col and score of the `top` nearest rows found for each row of `queries`."""
    spark = df.sparkSession
    ship(spark)
    rows, asked = sound(df, id_col, vector_col), sound(queries, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    same = F.size("v") == common["width"]
    rows, asked = rows.filter(same), asked.filter(same).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    largest = rows.agg(F.max(norm)).first()[0]
    nodes, n_shards = _nodes(rows, top + 1, shard_rows)
    graph = build(nodes, largest, k, rounds, least_change)
    found = search(nodes, graph, asked, largest, n_shards, top, k, beam)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, top)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.minus")).alias("score")
    )
