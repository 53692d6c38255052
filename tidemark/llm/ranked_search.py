"""Ranked lexical search: MaxScore over blocks of documents, with bounds of term pairs.

Terms are runs of digits, letters and characters beyond ASCII; only A to Z are lower-cased. N counts the documents with
at least one term, L all their terms, n one document's terms, df the documents that hold a term, tf its occurrences in
a document. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 50 + (50 n N) div L, and a score is the
sum of w * ((10^9 tf) div (1000 tf + 20 m)) over an item's terms, once each: integers but for the logarithm.

The index holds a row per block of at most `block_rows` documents or `BLOCK_BYTES` bytes (a longer text stands alone): its
documents in the order of their ids, its terms in order, each term's postings (row and factor) and largest factor. Beside
these stand the intersection lists of term pairs: for every block with documents that hold both terms, how many there are
and their largest joint impact. Pairs are terms that are neighbours in an item of the query log, by weight; an index
has lists for the `max_pairs` most frequent ones, a bound of what is broadcast while it is built. Pairs without lists, and items
that the log doesn't know, are bounded by single terms, with the same results.

A query's terms stand in the order of their weights. The bound of its first j terms in a block is the least of what follows
from the bound of j - 1 terms and the j-th largest impact, and from the bound of j - 2 terms and what the pair of the
last two can give: the largest of its joint impact and of either term alone. A block whose whole bound is below the
query's k-th score is skipped; in others the leading terms whose bound stays below it only complete the scores of documents that
hold a later term, and a document is dropped where its score so far and the bound of what is left stay below it.

Queries travel in blocks of about `QUERY_ROWS` items, each broadcast by itself; every task keeps the best `top` per query,
so its bar rises from block to block. A sixteenth of the index, chosen by hash, is searched first; the k-th score found
there goes along to the rest. What the tasks found is narrowed down in lanes before a query's last step.

Null texts and texts without terms are ranked nowhere. Rows with a null id count in all statistics and are never returned;
neither are items with a null id. Repeated rows are documents of their own. Rows of `items` with equal ids are one item with the terms of
all; an item without terms that occur has no rows. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import give_back_memory, keep, ship

BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
# Of the tables that Python functions read. A block and its postings take some MB; by default a task would hold 64 MB of them, in Python
# and, beside its heap, in the JVM.
BATCH_BYTES = 4 << 20
QUERY_ROWS = 256
MAX_PAIRS = 1 << 16
PAIR_POSTINGS = 1 << 20
FIRST_OF = 16
LANES = 64

_keep = partial(keep, batch_bytes=BATCH_BYTES)
_of_blocks = partial(_keep, read_rows=1)  # what is made of blocks, whose rows are that large

# What separates terms becomes a blank, A to Z become a to z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in order, in lists from pieces that end between terms."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


class _Block:
    """Documents that are waiting to become one row of the inverted table."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.counts, self.bytes = [], [], [], [], 0
        self.vocabulary = defaultdict(count().__next__)

    def add(self, doc, text: bytes) -> None:
        pieces = [np.fromiter(map(self.vocabulary.__getitem__, x), np.int64, len(x)) for x in words(text)]
        n = sum(map(len, pieces))
        if n:
            terms, counts = np.unique(np.concatenate(pieces), return_counts=True)
            self.ids.append(doc)
            self.lengths.append(n)
            self.terms.append(terms)
            self.counts.append(counts)
            self.bytes += len(text)

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        ids = pa.array(self.ids, id_type)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms = sorted(self.vocabulary)
        rank = np.empty(len(terms), np.int64)
        rank[[self.vocabulary[x] for x in terms]] = np.arange(len(terms))
        term = rank[np.concatenate(self.terms)]
        row = np.repeat(place, [len(x) for x in self.terms])
        sequence = np.lexsort((row, term))
        dfs = np.bincount(term, minlength=len(terms))
        columns = {
            "block": pa.array([number], pa.int64()),
            "ids": _listed(ids.take(pa.array(order))),
            "lengths": _listed(pa.array(np.array(self.lengths, np.int64)[order])),
            "terms": _listed(pa.array(terms, pa.binary()).cast(pa.string())),
            "dfs": _listed(pa.array(dfs.astype(np.int32))),
            "rows": _listed(pa.array(row[sequence].astype(np.int32))),
            "tfs": _listed(pa.array(np.concatenate(self.counts)[sequence])),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _listed(values: pa.Array) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def invert(df: DataFrame, id_col: str, text_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per block of documents: their ids and lengths, the terms, and each term's documents and counts."""
    ship(df.sparkSession)
    narrow = df.select(df[id_col].alias("id"), df[text_col].cast("binary").alias("text")).filter("text IS NOT NULL")
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        first, held, kind = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                held.add(doc, text.as_buffer().to_pybytes())
                if len(held.ids) >= block_rows or held.bytes >= BLOCK_BYTES:
                    yield held.row(first, kind)
                    first, held = first + 1, _Block()
        if held.ids:
            yield held.row(first, kind)

    return narrow.mapInArrow(
        run,
        f"block long, ids array<{id_type}>, lengths array<long>, terms array<string>, dfs array<int>, rows array<int>, tfs array<long>",
    )


@dataclass(frozen=True)
class Corpus:
    """The inverted table, and N and L of all its documents."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def corpus(blocks: DataFrame) -> Corpus:
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = blocks.agg(F.sum(F.size("ids")), F.sum(length)).first()
    return Corpus(blocks, n or 0, total or 0)


def weigh(found: Corpus, items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, query (the block of queries it belongs to) and terms, an array of (w, term) in ascending order."""
    spark = items.sparkSession
    ship(spark)
    narrow = items.select(items[item_col].alias("item"), items[text_col].cast("binary").alias("text"))
    narrow = narrow.filter("item IS NOT NULL AND text IS NOT NULL")
    item_type = narrow.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                terms = pa.array(sorted({w for x in words(text.as_buffer().to_pybytes()) for w in x}), pa.binary())
                of = pa.array(np.full(len(terms), i, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(of), terms.cast(pa.string())], names=["item", "term"])

    asked = _keep(narrow.mapInArrow(run, f"item {item_type}, term string").distinct(), "search-items")
    held = found.blocks.select(F.inline(F.arrays_zip("terms", "dfs"))).withColumnRenamed("terms", "term")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("dfs").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * found.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighted = asked.join(df, "term").withColumn("w", w.cast("long")).filter("w > 0")
    of_items = weighted.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("w", "term"))).alias("terms"))
    blocks = max(1, -(-asked.select("item").distinct().count() // QUERY_ROWS))
    return of_items.withColumn("query", F.pmod(F.xxhash64("item"), F.lit(blocks)))


def frequent_pairs(weighted: DataFrame, max_pairs: int = MAX_PAIRS) -> list[tuple[str, str, int, int]]:
    """The pairs of terms, (a, b, weight of a, weight of b), that stand beside each other in most items: a top-k."""
    neighbours = F.transform(
        F.sequence(F.lit(1), F.size("terms") - 1),
        lambda i: F.struct(F.get("terms", i - 1).alias("a"), F.get("terms", i).alias("b")),
    )
    pairs = weighted.filter(F.size("terms") > 1).select(F.inline(neighbours))
    most = pairs.groupBy("a", "b").count().orderBy(F.desc("count"), "a", "b").limit(max_pairs)
    return [(r["a"]["term"], r["b"]["term"], r["a"]["w"], r["b"]["w"]) for r in most.collect()]


def _values(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def joint_impacts(
    n_docs: int, starts: np.ndarray, rows: np.ndarray, factors: np.ndarray,
    a: np.ndarray, b: np.ndarray, w_a: np.ndarray, w_b: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a block's terms: how many documents hold both, and their largest joint impact (0 for none)."""
    docs, joint = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    sizes = starts[a + 1] - starts[a] + starts[b + 1] - starts[b]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIR_POSTINGS, sizes.sum() + PAIR_POSTINGS, PAIR_POSTINGS), "right")
    first = 0
    for last in [*np.maximum(cuts, 1), len(a)]:
        if last <= first:
            continue
        own = np.arange(last - first)
        keys, at = [], []
        for term in (a[first:last], b[first:last]):
            length = starts[term + 1] - starts[term]
            pair = np.repeat(own, length)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts[term], length)
            keys.append(pair * n_docs + rows[place])
            at.append(place)
        found = np.minimum(np.searchsorted(keys[0], keys[1]), max(len(keys[0]) - 1, 0))
        both = np.flatnonzero(keys[0][found] == keys[1])
        pair = keys[1][both] // n_docs
        impact = w_a[first + pair] * factors[at[0][found[both]]] + w_b[first + pair] * factors[at[1][both]]
        np.add.at(docs, first + pair, 1)
        np.maximum.at(joint, first + pair, impact)
        first = last
    return docs, joint


def index(found: Corpus, pairs: list[tuple[str, str, int, int]]) -> DataFrame:
    """A row per block: its postings with factors, each term's largest factor, and its entries of the pairs' intersection lists."""
    spark = found.blocks.sparkSession
    ship(spark)
    n, total = found.n_docs, found.n_terms
    shared = spark.sparkContext.broadcast(
        (np.array([x[0] for x in pairs], object), np.array([x[1] for x in pairs], object),
         np.array([x[2] for x in pairs], np.int64), np.array([x[3] for x in pairs], np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        first, second, w_first, w_second = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                place = {x: k for k, x in enumerate(batch.column("terms")[i].as_py())}
                lengths, dfs, rows, tfs = (_values(batch, x, i) for x in ("lengths", "dfs", "rows", "tfs"))
                m = 50 + (50 * lengths * n) // total
                factors = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows])
                starts = np.concatenate(([0], np.cumsum(dfs, dtype=np.int64)))
                a = np.fromiter((place.get(x, -1) for x in first), np.int64, len(first))
                b = np.fromiter((place.get(x, -1) for x in second), np.int64, len(second))
                known = np.flatnonzero((a >= 0) & (b >= 0))
                docs, joint = joint_impacts(len(lengths), starts, rows, factors, a[known], b[known], w_first[known], w_second[known])
                some = docs > 0
                columns = {
                    "factors": factors.astype(np.int32),
                    "peaks": np.maximum.reduceat(factors, starts[:-1]).astype(np.int32),
                    "pairs": known[some].astype(np.int32),
                    "pair_docs": docs[some].astype(np.int32),
                    "joint": joint[some],
                }
                kept = ["block", "ids", "terms", "dfs", "rows"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(i, 1) for x in kept] + [_listed(pa.array(x)) for x in columns.values()],
                    names=[*kept, *columns],
                )

    id_type = found.blocks.schema["ids"].dataType.simpleString()
    return found.blocks.mapInArrow(
        run,
        f"block long, ids {id_type}, terms array<string>, dfs array<int>, rows array<int>, factors array<int>, "
        "peaks array<int>, pairs array<int>, pair_docs array<int>, joint array<long>",
    )


class Queries:
    """A block of items: their terms by position, padded to the longest, with weights and the pairs that have lists."""

    def __init__(self, items: list[tuple], pairs: dict[tuple[str, str], int], top: int):
        self.items, self.top = [x[0] for x in items], top
        longest = max(len(x[1]) for x in items)
        self.terms = sorted({t for _, terms, _ in items for _, t in terms})
        place = {x: i for i, x in enumerate(self.terms)}
        self.term = np.full((len(items), longest), -1, np.int64)
        self.w = np.zeros((len(items), longest), np.int64)
        self.pair = np.full((len(items), longest), -1, np.int64)
        for i, (_, terms, _) in enumerate(items):
            self.term[i, : len(terms)] = [place[t] for _, t in terms]
            self.w[i, : len(terms)] = [w for w, _ in terms]
            self.pair[i, 1 : len(terms)] = [pairs.get((p[1], q[1]), -1) for p, q in zip(terms, terms[1:])]
        # a score below its bar can't be among the best
        self.bar = np.array([x[2] or 1 for x in items], np.int64)
        self.best: list[list[tuple]] = [[] for _ in items]

    def bounds(self, known: np.ndarray, peaks: np.ndarray, pairs: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """items x (terms + 1): what the first j terms of an item can add up to in one document of a block.

        `known` has the place of every term of the queries in the block, -1 where it has none.
        """
        of_term = np.where(known >= 0, peaks[np.maximum(known, 0)], 0) if len(peaks) else np.zeros(len(known), np.int64)
        single = np.where(self.term >= 0, of_term[self.term], 0) * self.w
        at = np.minimum(np.searchsorted(pairs, self.pair), max(len(pairs) - 1, 0))
        met = (pairs[at] == self.pair) & (self.pair >= 0) if len(pairs) else np.zeros(self.pair.shape, np.bool_)
        together = np.where(met, joint[at], 0) if len(pairs) else np.zeros(self.pair.shape, np.int64)
        upto = np.zeros((len(self.items), self.term.shape[1] + 1), np.int64)
        for j in range(self.term.shape[1]):
            upto[:, j + 1] = upto[:, j] + single[:, j]
            if j:
                pair = np.maximum(np.maximum(single[:, j - 1], single[:, j]), together[:, j])
                listed = self.pair[:, j] >= 0
                upto[listed, j + 1] = np.minimum(upto[listed, j + 1], upto[listed, j - 1] + pair[listed])
        return upto

    def search(self, batch: pa.RecordBatch, i: int) -> int:
        """Search one block of the index; returns for how many items its postings were opened."""
        place = {x: k for k, x in enumerate(batch.column("terms")[i].as_py())}
        known = np.fromiter((place.get(x, -1) for x in self.terms), np.int64, len(self.terms))
        peaks, pairs, joint = (_values(batch, x, i).astype(np.int64) for x in ("peaks", "pairs", "joint"))
        upto = self.bounds(known, peaks, pairs, joint)
        open_ = np.flatnonzero(upto[:, -1] >= self.bar)
        if not len(open_):
            return 0
        ids = batch.column("ids")[i].values
        n_ids = len(ids) - ids.null_count  # null ids stand at the end
        rows, factors = _values(batch, "rows", i), _values(batch, "factors", i)
        starts = np.concatenate(([0], np.cumsum(_values(batch, "dfs", i), dtype=np.int64)))
        for q in open_:
            at, scores = self._scored(q, known, upto[q], starts, rows, factors, n_ids)
            if len(at):
                self._take(q, ids.take(pa.array(at)).to_pylist(), scores)
        return len(open_)

    def _scored(self, q, known, upto, starts, rows, factors, n_ids) -> tuple[np.ndarray, np.ndarray]:
        """The best rows of a block that reach the item's bar, and their scores."""
        bar = self.bar[q]
        place = np.where(self.term[q] >= 0, known[self.term[q]], -1)
        # the leading terms that can't reach the bar by themselves
        leading = int(np.searchsorted(upto, bar, "left")) - 1
        here = np.flatnonzero(place >= 0)
        later = here[here >= leading]
        stretches = [slice(starts[p], starts[p + 1]) for p in place[later]]
        if not stretches:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        impacts = np.concatenate([factors[s] * w for s, w in zip(stretches, self.w[q, later])])
        held = summed(np.concatenate([rows[s] for s in stretches]), impacts, n_ids)
        at = np.flatnonzero((held > 0) & (held + upto[leading] >= bar))
        scores = held[at]
        for j in here[here < leading][::-1]:
            enough = scores + upto[j + 1] >= bar
            at, scores = at[enough], scores[enough]
            if not len(at):
                break
            s = slice(starts[place[j]], starts[place[j] + 1])
            found = np.minimum(np.searchsorted(rows[s], at), s.stop - s.start - 1)
            scores = scores + np.where(rows[s][found] == at, factors[s][found] * self.w[q, j], 0)
        enough = scores >= bar
        at, scores = at[enough], scores[enough]
        if len(at) > self.top:
            chosen = np.lexsort((at, -scores))[: self.top]
            at, scores = at[chosen], scores[chosen]
        return at, scores

    def _take(self, q: int, ids: list, scores: np.ndarray) -> None:
        merged = sorted(self.best[q] + [(-s, x) for s, x in zip(scores.tolist(), ids)])[: self.top]
        self.best[q] = merged
        if len(merged) == self.top:
            self.bar[q] = max(self.bar[q], -merged[-1][0])

    def found(self) -> list[tuple]:
        return [(item, x, -minus) for item, best in zip(self.items, self.best) for minus, x in best]


def summed(rows: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
    """The sum of the impacts per row, for the first n rows: in doubles while they hold every integer, else in long integers."""
    impacts = impacts.astype(np.int64)
    if float(impacts.sum(dtype=np.float64)) < 2.0**53:
        return np.bincount(rows, impacts, n)[:n].astype(np.int64)
    sums = np.zeros(max(n, int(rows.max(initial=0)) + 1), np.int64)
    np.add.at(sums, rows, impacts)
    return sums[:n]


def _best(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _narrowed(hits: DataFrame, top: int) -> DataFrame:
    """The best per item: in lanes first, so that no task gets what all tasks have found."""
    lanes = hits.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(LANES)))
    return _best(_best(lanes, ["item", "lane"], top).drop("lane", "rank"), ["item"], top)


def _hits(blocks: DataFrame, queries: list[tuple], pairs: dict[tuple[str, str], int], top: int, schema: str, kinds: list) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((queries, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        asked = Queries(*shared.value, top)
        for batch in batches:
            for i in range(batch.num_rows):
                asked.search(batch, i)
        columns = zip(*found) if (found := asked.found()) else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["item", "id", "score"])

    return blocks.mapInArrow(run, schema)


def search(
    blocks: DataFrame, weighted: DataFrame, pairs: list[tuple[str, str, int, int]], top: int,
    id_col: str = "doc_id", item_col: str = "item_id",
) -> DataFrame:
    """item_col, rank, id_col and score of the `top` best documents of an index for every weighted item."""
    spark = blocks.sparkSession
    ship(spark)
    id_type, item_type = blocks.schema["ids"].dataType.elementType, weighted.schema["item"].dataType
    schema = f"item {item_type.simpleString()}, id {id_type.simpleString()}, score long"
    kinds = [to_arrow_type(item_type), to_arrow_type(id_type), pa.int64()]
    of_pair = {(a, b): i for i, (a, b, _, _) in enumerate(pairs)}
    first = F.pmod(F.xxhash64(F.lit("first"), "block"), F.lit(FIRST_OF)) == 0
    parts = []
    for query in sorted(r["query"] for r in weighted.select("query").distinct().collect()):
        asked = [(r["item"], [(t["w"], t["term"]) for t in r["terms"]]) for r in weighted.filter(F.col("query") == query).collect()]
        wanted = {(p[1], q[1]) for _, terms in asked for p, q in zip(terms, terms[1:])}
        own = {x: of_pair[x] for x in wanted if x in of_pair}
        early = _of_blocks(_narrowed(_hits(blocks.filter(first), [(*x, None) for x in asked], own, top, schema, kinds), top), "search-first")
        reach = {r["item"]: r["score"] for r in early.filter(F.col("rank") == top).collect()}
        late = _hits(blocks.filter(~first), [(*x, reach.get(x[0])) for x in asked], own, top, schema, kinds)
        parts.append(_of_blocks(_narrowed(early.drop("rank").unionByName(late), top), "search-best"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_type.simpleString()}, rank int, `{id_col}` {id_type.simpleString()}, score long")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def best_documents(
    df: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_rows: int = BLOCK_ROWS, max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """Index df, with the items themselves as the query log, and rank its documents for each item."""
    found = corpus(_keep(invert(df, id_col, text_col, block_rows), "search-blocks"))
    weighted = _of_blocks(weigh(found, items, item_col, item_text_col), "search-items")
    pairs = frequent_pairs(weighted, max_pairs)
    return search(_of_blocks(index(found, pairs), "search-index"), weighted, pairs, top, id_col, item_col)
