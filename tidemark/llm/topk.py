"""Exact top-k inner products of integer vectors, by a KD-tree per shard.

Vectors are multiplied by `scale` and rounded down. They are dealt to shards of about `shard_rows` by a hash of the
id. Within a shard a KD-tree splits at the median of the widest component down to leaves of `leaf_rows`; every node
keeps its tight bounding box. A box bounds the product with a query: the sum over components of the larger of
query times lower side and query times upper side. A query walks the tree best bound first and ends
where no bound reaches its k-th score; a node of just that bound is still opened, since ties go to the smaller id.

Every query first searches the shard it belongs to. The k-th score found there goes with it to all other shards, which
prune with it from the start. Queries meet shards in blocks: `block_rows` queries, all boxes of a shard and matrices in
numpy, with sums in integers where floating point would round.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids, nor vectors of another
length than most have. Rows that repeat an id and its vector count once, other rows of one id each; a query's own id is no
candidate. A repeated query id has one result, for its first vector in order. A score beyond a long is an error. An empty table has no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import keep, ship

SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_ROWS = 1024


class KDTree:
    """Nodes in one list; leaves hold rows, sorted by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids, self.vectors = ids, vectors
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._grow(np.argsort(ids, kind="stable"), leaf_rows)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> None:
        waiting = [(rows, -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            own = self.vectors[rows]
            at = len(self.low)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.children.append([-1, -1])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent][side] = at
            wide = self.high[-1].astype(np.float64) - self.low[-1]
            axis = int(wide.argmax())
            if len(rows) > leaf_rows and wide[axis] > 0:
                order = np.argsort(own[:, axis], kind="stable")
                half = len(rows) // 2
                waiting += [(np.sort(rows[order[half:]]), at, 1), (np.sort(rows[order[:half]]), at, 0)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of every query's product with every node's rows."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return products(up, self.high) + products(down, self.low)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, reach: int | None) -> list[tuple[int, int]]:
        """Up to k (score, -id), the smallest first, of rows that score `reach` at least."""
        best: list[tuple[int, int]] = []
        heap = [(-int(bound[0]), 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else reach
            if kth is not None and -upper < kth:
                break
            children = self.children[node]
            if children[0] >= 0:
                for child in children:
                    heapq.heappush(heap, (-int(bound[child]), child))
                continue
            rows = self.rows[node]
            scores = products(query[None, :], self.vectors[rows])[0]
            worth = np.flatnonzero(scores >= kth) if kth is not None else np.arange(len(rows))
            for i in worth:
                found = (int(scores[i]), -int(self.ids[rows[i]]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles while no sum can leave their integers, else in long integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("a score may not fit into 64 bits; use a smaller scale")


def quantize(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v (array of long) of the rows that take part."""
    x = F.transform(df[vector_col], lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    sound = F.forall(df[vector_col], lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.filter(df[vector_col].isNotNull() & df[id_col].isNotNull()).filter((F.size(df[vector_col]) > 0) & sound)
    return rows.select(df[id_col].cast("long").alias("id"), x.alias("v"))


def _pack(rows: DataFrame, key: list[str], width: int) -> DataFrame:
    """One row per key: its ids and its vectors as one matrix each, in bytes."""
    ship(rows.sparkSession)

    def stack(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs:
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                ids = members.field("id").to_numpy(zero_copy_only=False).astype("<i8")
                matrix = members.field("v").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(i, 1) for x in key]
                    + [pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())],
                    names=[*key, "ids", "matrix"],
                )

    grouped = rows.groupBy(*key).agg(F.collect_list(F.struct("id", "v")).alias("members"))
    return grouped.mapInArrow(stack, ", ".join(f"{x} long" for x in key) + ", ids binary, matrix binary")


def top_k(
    df: DataFrame, queries: DataFrame, k: int, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank, id_col and score of the k best rows of df for each row of `queries`."""
    spark = df.sparkSession
    rows = quantize(df, id_col, vector_col, scale).distinct()
    asked = quantize(queries, id_col, vector_col, scale)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    out = f"query_id long, rank int, `{id_col}` long, score long"
    if common is None:
        return spark.createDataFrame([], out)
    width, n = common["width"], common["count"]
    n_shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(n_shards))
    packed = keep(_pack(rows.filter(F.size("v") == width).withColumn("shard", shard), ["shard"], width), "topk")

    asked = asked.filter(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v")).withColumn("home", shard)
    n_asked = asked.count()
    n_blocks = max(1, -(-n_asked // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(n_blocks)))
    # a block and its shard meet by a key; first every query meets its own shard
    homes = asked.withColumn("shard", F.col("home"))
    first = keep(_search(homes.withColumn("reach", F.lit(None).cast("long")), packed, k, width, leaf_rows), "topk")
    reach = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("found"))
    reach = reach.select(F.col("query_id").alias("id"), F.when(F.col("found") >= k, F.col("worst")).alias("reach"))
    others = asked.join(reach, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    others = others.filter("shard <> home").withColumn("shard", F.col("shard").cast("long"))
    found = first.unionByName(_search(others, packed, k, width, leaf_rows)) if n_shards > 1 else first
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.minus")).alias("score")
    )


def _search(asked: DataFrame, packed: DataFrame, k: int, width: int, leaf_rows: int) -> DataFrame:
    """query_id, id and score: up to k rows per query and shard; asked has id, v, shard, block and reach."""
    blocks = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("id", "v", "reach")).alias("members"))
    pairs = blocks.join(packed, "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                tree = KDTree(ids, np.frombuffer(batch.column("matrix")[i].as_py(), "<i8").reshape(-1, width), leaf_rows)
                members = batch.column("members")[i].values
                own = members.field("id").to_pylist()
                reach = members.field("reach").to_pylist()
                queries = members.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                bounds = tree.bounds(queries)
                found = [
                    (own[q], -minus, score)
                    for q in range(len(own))
                    for score, minus in tree.search(queries[q], own[q], bounds[q], k, reach[q])
                ]
                columns = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "id", "score"])

    return pairs.mapInArrow(search, "query_id long, id long, score long")
