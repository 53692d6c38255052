"""Exact similarity join of word-shingle sets, by partitions of the universe of shingles.

Two sets link when their Jaccard similarity is at least `percent` / 100. With sizes that sum to S their symmetric
difference is then at most S * (100 - percent) / (100 + percent).

* Sets are grouped into bands of sizes; a set just below a band is in that band too. For a band the largest possible
  difference is k, and the shingles are hashed into k + 1 segments, so in one segment at least two linked sets
  agree. A set is indexed under its subset in every segment.
* Subsets of fewer than `least` shingles agree by chance, so they aren't indexed. If all segments in which two linked sets
  agree are so thin, then fewer errors than segments are left for the others, and all but a few differ in just one shingle.
  With t thin segments of a set and s of just `least` shingles, of any w = 2t + s segments one differs in one shingle and isn't
  thin without it. So a set is indexed under the one-deletion neighbourhoods of its first w segments too. A set with w above the
  number of segments has its thin subsets indexed after all.
* `least` is allotted per band by cost: index rows against the chance of equal keys of unlike sets.

Equal sets are one node. The index is shuffled in packed rows. Of a task's nodes with the same key only one, their hub, goes to the key's
bucket, so that a key which very many sets share is no large group there; the hubs of all tasks have one among them in turn.
Candidates are (hub, member) pairs, linear in the index. A fingerprint per set,
the shingles' sums in a few times k small cells, gives a lower bound of the difference that discards most pairs unlike;
what is left is verified exactly on the sets themselves. Then, until nothing is open: members that aren't in their hub's
  component, its strays, are compared with all other members of the key by fingerprint, a block of strays with a block of
  members at a time, and verified, so no link is lost. Where a key has more strays than a block, most are unlike: there the sets of all
  such keys meet under other keys instead, each set's rarest shingles. With n shingles these are the first n - ceil(n * percent / 100) + 1
  in an order that all sets share, and of two linked sets at least one of them is the same. Components come from the links.

Words are runs of `[^ \\t-\\r]`, A to Z lower-cased. A text with fewer words than a shingle has is one shingle; one without
words, empty or null, has no shingle and no link. Null ids are kept as such and never name a component unless it has no other.
Rows that repeat an id are nodes by their own texts. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, give_back_memory, keep, release, rows_with_keys, ship
from tidemark.llm.components import components
from tidemark.llm.runs import sorted_runs, starts_of

BATCH_BYTES = 4 << 20
CHUNK_BYTES = 256 << 10
BLOCK = 512
# Partners of a stray that are tried before the rest.
LIKELIEST = 8
SHORT = 128
SLOTS = 1 << 20  # of the table of how often shingles occur
PACKED_KEYS = 1 << 20  # keys that a task gathers before it packs them
KEY_BYTES = 5  # of a key below the bits that name its bucket
NODES_PER_BUCKET = 2000
STEP = 1.25  # from one band of sizes to the next; a linked set is at most in the next one
CHANCE_COST = 10.0  # index rows that one candidate pair costs
AGREEMENT = 0.5  # how likely unlike sets are taken to share one shingle
U64 = np.uint64

_keep = partial(keep, name="jaccard", batch_bytes=BATCH_BYTES)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers for each seed."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(256, dtype=U64), 1)
_BYTE[65:91] = _BYTE[97:123]
_FACTOR = U64(0x9E3779B97F4A7C17)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some text start, and their hashes."""
    letter = ~_SPACE[data]
    before = np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return starts, np.empty(0, U64)
    lengths = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1 - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.ones(int(lengths.max()), U64)
    with np.errstate(over="ignore"):
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _FACTOR))
        sums = np.add.reduceat(_BYTE[data[letter]] * powers[place], first)
        return starts, mix(sums + lengths.astype(U64), 2)


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of every text, hashed and sorted."""
    out = []
    for start, end in _chunks(texts):
        data = np.frombuffer(b" ".join(texts[start:end]), np.uint8)
        begin = np.cumsum([0] + [len(x) + 1 for x in texts[start:end]])
        starts, words = _word_hashes(data)
        bounds = np.searchsorted(starts, begin)
        rolled = []  # of one word, of two and so on
        with np.errstate(over="ignore"):
            for i in range(min(width, len(words))):
                rolled.append(mix(words if not i else rolled[-1][:-1] + words[i:], 3 + i))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            many = min(width, high - low)
            out.append(np.unique(rolled[many - 1][low : high - many + 1]) if many else np.empty(0, U64))
    return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > CHUNK_BYTES:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def set_key(items: np.ndarray) -> int:
    """A key of the whole set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mix(items, 11).sum(dtype=U64) + U64(len(items))
    return int(mix(np.array([total], U64), 12).view(np.int64)[0])


class Bands:
    """Bands of sizes, their numbers of segments and the smallest indexed subsets."""

    def __init__(self, percent: int):
        if not 100 / STEP <= percent <= 100:
            raise ValueError(f"percent must be from {math.ceil(100 / STEP)} to 100")
        self.percent = percent
        self.step = STEP

    def difference(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to `total`."""
        return total * (100 - self.percent) // (100 + self.percent)

    def link(self, x: bytes, y: bytes) -> bool:
        """Whether two sets of shingles, sorted 64-bit integers, are alike enough."""
        x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def start(self, band: int) -> int:
        return math.ceil(self.step**band)

    @cache
    def of(self, size: int) -> tuple[int, ...]:
        """The bands that a set of this size is indexed in."""
        band = max(0, int(math.log(size, self.step)) - 1)
        while self.start(band + 1) <= size:
            band += 1
        above = self.start(band + 1)
        return (band, band + 1) if 100 * size >= self.percent * above else (band,)

    @cache
    def plan(self, band: int) -> tuple[int, int]:
        """The number of segments and `least`."""
        below = self.start(band + 1)
        segments = self.difference(2 * (below - 1)) + 1
        mean = (self.start(band) + below) / 2 / segments
        return segments, min((1, 2, 3), key=lambda least: self._cost(mean, least))

    def _cost(self, mean: float, least: int) -> float:
        share = [math.exp(-mean) * mean**c / math.factorial(c) for c in range(60)]
        rows = sum(share[least:]) + min(1.0, 2 * sum(share[:least]) + share[least]) * mean
        return rows + CHANCE_COST * sum(p * AGREEMENT**c for c, p in enumerate(share) if c >= least)

    def cells(self, size: int) -> int:
        """The number of cells of a fingerprint, a power of two."""
        return 1 << max(6, (4 * self.difference(2 * size)).bit_length())


def index_keys(items: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys a set is indexed under."""
    out, place, value = [], mix(items, 21), mix(items, 22)
    for band in bands.of(len(items)) if len(items) else ():
        segments, least = bands.plan(band)
        if segments == 1:
            continue  # only equal sets link
        segment = (place % U64(segments)).astype(np.int64)
        sums, sizes = np.zeros(segments, U64), np.bincount(segment, minlength=segments)
        np.add.at(sums, segment, value)
        names = mix(np.arange(segments, dtype=U64) + U64(band << 32), 23)
        weak = 2 * int((sizes < least).sum()) + int((sizes == least).sum())
        with np.errstate(over="ignore"):
            out.append(mix((sums + names)[(sizes >= least) | (weak > segments)], 24))
            near = (segment < weak) & (sizes[segment] > least)
            out.append(mix(sums[segment[near]] - value[near] + names[segment[near]], 24))
    return np.concatenate(out) if out else np.empty(0, U64)


def fingerprint(items: np.ndarray, bands: Bands) -> bytes:
    hashed = mix(items, 31)
    cells = bands.cells(len(items))
    at = (hashed & U64(cells - 1)).astype(np.int64)
    return np.bincount(at, weights=(hashed >> U64(56)).astype(np.float64), minlength=cells).astype(np.int64).astype(np.uint8).tobytes()


def folded(a: np.ndarray, cells: int) -> np.ndarray:
    """Fingerprints with no more than so many cells."""
    while a.shape[-1] > cells:
        a = a[..., : a.shape[-1] // 2] + a[..., a.shape[-1] // 2 :]
    return a


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the differences of all rows of a with all rows of b."""
    a, b = folded(a, b.shape[1]), folded(b, a.shape[1])
    return np.stack([(row != b).sum(axis=1) for row in a]) if len(a) else np.zeros((0, len(b)), np.int64)


def _nodes(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """id, node, n, print and short (the print folded to few cells) of every row; a row without shingles has null node."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sets = shingles([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], width)
            prints = [fingerprint(x, bands) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array([None if x is None else folded(np.frombuffer(x, np.uint8), SHORT).tobytes() for x in prints], pa.binary()),
                ],
                names=["id", "node", "n", "print", "short"],
            )

    return docs.mapInArrow(run, f"id {id_type}, node long, n long, print binary, short binary")


def _key_runs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, node) in order of key, with the key's first node as hub, its number of nodes and the place among them. Bits of
    the node are flipped by the key before they are ordered, so that the hub is another one for each key."""
    order = np.lexsort((node ^ key, key))
    key, node = key[order], node[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    key, node = key[fresh], node[fresh]
    starts = starts_of(key)
    sizes = np.diff(np.append(starts, len(key)))
    return key, node, np.repeat(node[starts], sizes), np.repeat(sizes, sizes), np.arange(len(key)) - np.repeat(starts, sizes)


def _packed(keys: np.ndarray, low: int) -> bytes:
    """Keys of one bucket, in order: a plane of bytes after the other, of which the first repeat."""
    part = (keys.view(U64) >> U64(low)).view(np.uint8).reshape(-1, 8)
    return part[:, KEY_BYTES - 1 :: -1].T.tobytes()


def _unpacked(planes: bytes, bucket: int, low: int) -> np.ndarray:
    part = np.zeros((len(planes) // KEY_BYTES, 8), np.uint8)
    part[:, KEY_BYTES - 1 :: -1] = np.frombuffer(planes, np.uint8).reshape(KEY_BYTES, -1).T
    return ((part.view(U64)[:, 0] + (U64(bucket) << U64(8 * KEY_BYTES))) << U64(low)).view(np.int64)


def _members(docs: DataFrame, width: int, bands: Bands, n_buckets: int) -> DataFrame:
    """key, node and hub of the keys that more than one node has.

    Keys travel in packed rows, one per task and bucket of keys. Where several nodes of a task have a key, only their hub travels to
    the key's bucket, so however many nodes share a key, its bucket gets one per task; the others go to any bucket with their hub.
    Of a key's bits those that name the bucket and the next 40 count: keys that differ in the others only make candidates that
    aren't alike.
    """
    bits = n_buckets.bit_length() - 1
    low = 64 - bits - 8 * KEY_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        had: set[int] = set()
        keys, nodes, waiting = [], [], 0

        def packed() -> Iterator[tuple]:
            every = np.concatenate(keys) >> U64(low) << U64(low)
            key, node, hub, size, place = _key_runs(every.view(np.int64), np.concatenate(nodes))
            keys.clear()
            nodes.clear()
            # what is known here and needs no further look: marked by a bucket below 0
            several = np.flatnonzero(size > 1)
            for rows, mark in ((np.flatnonzero(place == 0), 0), (several, -1)):
                of = (key[rows].view(U64) >> U64(64 - bits)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                rows, of = rows[order], of[order]
                for start, end in zip(starts_of(of), np.append(starts_of(of)[1:], len(of))) if len(of) else ():
                    part = rows[start:end]
                    name = int(of[start]) if mark == 0 else -1 - int(of[start])
                    hubs = hub[part].tobytes() if mark else b""
                    yield (name, _packed(key[part], low), node[part].tobytes(), hubs)

        def out() -> Iterator[pa.RecordBatch]:
            rows = packed()
            while some := list(islice(rows, 256)):
                types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), types)], names=["bucket", "keys", "nodes", "hubs"])

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for items in shingles([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], width):
                node = set_key(items) if len(items) else None
                if node is None or node in had:
                    continue  # copies of a set are one node
                had.add(node)
                found = index_keys(items, bands)
                keys.append(found)
                nodes.append(np.full(len(found), node, np.int64))
                waiting += len(found)
            if waiting >= PACKED_KEYS:
                yield from out()
                waiting = 0
        if waiting:
            yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        at, held = None, []

        def rows(key, node, hub) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, hub)], names=["key", "node", "hub"])

        def bucket() -> pa.RecordBatch:
            keys, nodes = zip(*held)
            key, node = np.concatenate([_unpacked(x, at, low) for x in keys]), np.frombuffer(b"".join(nodes), np.int64)
            key, node, hub, size, _ = _key_runs(key, node)
            more = size > 1
            return rows(key[more], node[more], hub[more])

        for batch in batches:
            for name, keys, nodes, hubs in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "nodes", "hubs"))):
                if name < 0:
                    yield rows(_unpacked(keys, -1 - name, low), np.frombuffer(nodes, np.int64), np.frombuffer(hubs, np.int64))
                    continue
                if held and name != at:
                    yield bucket()
                    held = []
                at = name
                held.append((keys, nodes))
        if held:
            yield bucket()

    sent = docs.select("text").mapInArrow(pack, "bucket long, keys binary, nodes binary, hubs binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "key long, node long, hub long")


def _by_fingerprint(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose fingerprints allow a link."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("print").alias("pa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("print").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb")))
            good = [
                int(least_difference(np.frombuffer(p, np.uint8)[None], np.frombuffer(q, np.uint8)[None])[0, 0]) <= bands.difference(n + m)
                for n, m, p, q in rows
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # sizes alone settle many pairs
    joined = pairs.join(x, "a").join(y, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * bands.percent)
    return joined.mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and items (its shingles) of the wanted nodes, and of some others."""
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("id").alias("wanted")).distinct()
    asked = rows_with_keys(docs, F.coalesce(F.col("id").cast("string"), F.lit("")), ids.select(F.coalesce(F.col("wanted").cast("string"), F.lit(""))))
    texts = asked.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [x for x in shingles(texts, width) if len(x)]
            columns = [pa.array([set_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "items"])

    return texts.select("text").mapInArrow(sets, "node long, items binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) that link."""
    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                good.append(bands.link(*(batch.column(c)[i].as_buffer() for c in ("x", "y"))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = found.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = found.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """key and node: the rarest shingles of each set, as many as make sure that linked sets have one in common, where several sets
    have them. How often shingles occur is counted in a table of fixed size, which is all that reaches the driver."""

    def slots(items: np.ndarray) -> np.ndarray:
        return (mix(items, 51) & U64(SLOTS - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for items in batch.column("items").to_pylist():
                np.add.at(total, slots(np.frombuffer(items, U64)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counts = sets.select("items").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column("node").to_pylist(), batch.column("items").to_pylist()):
                items = np.frombuffer(items, U64)
                first = len(items) + 1 + -percent * len(items) // 100
                chosen = items[np.lexsort((items, shared.value[slots(items)]))[:first]]
                yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64)), pa.array(np.full(len(chosen), node))], names=["key", "node"])

    keys = _keep(sets.mapInArrow(rare, "key long, node long"))
    return keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")


def _sides(rows: DataFrame) -> DataFrame:
    """run, side, node and label: for each key of `rows` (key, main, block, node, label) every block of its members (side 0) with every
    block of its strays, which aren't labelled main (side 1)."""
    strays = rows.filter("label <> main").select("key", "node", "label")
    many = strays.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    part = F.pmod(F.xxhash64(F.lit("stray"), "node"), "many").alias("part")
    strays = strays.join(many, "key").select("key", "node", "label", part)
    members = rows.join(strays.select("key", "part").distinct(), "key")
    columns = [F.xxhash64("key", "block", "part").alias("run"), "node", "label"]
    return members.select(F.lit(0).alias("side"), *columns).unionByName(
        strays.join(rows.select("key", "block").distinct(), "key").select(F.lit(1).alias("side"), *columns)
    )


def _open_sides(members: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The runs (see _sides) in which every member outside its hub's component meets all members of the key."""
    of_node = labels.select("node", F.col("label").alias("own"))
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hubs"))
    known = members.join(of_node, "node", "left").join(of_hub, "hub", "left")
    known = known.select("key", "node", F.coalesce("own", "node").alias("label"), F.coalesce("hubs", "hub").alias("hubs"))
    known = _keep(known)
    # pieces of a key may have different hubs: only the smallest component of a key is no stray
    main = known.groupBy("key").agg(F.min("hubs").alias("main"), F.min("label").alias("low"), F.max("label").alias("high"))
    main = main.filter("low <> high").select("key", "main")
    rows = _keep(known.select("key", "node", "label").join(main, "key").dropDuplicates(["key", "node"]))
    release(known)
    # blocks by the key's size, however many tasks its members come from
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("many"), F.count_if(F.col("label") != F.col("main")).alias("strays"))
    sizes = _keep(sizes)
    wide = sizes.filter(F.col("strays") > BLOCK).select("key")
    block = F.pmod(F.xxhash64(F.lit("member"), "node"), "many").alias("block")
    narrow = rows.join(sizes.filter(F.col("strays") <= BLOCK), "key")
    sides = _sides(narrow.select("key", "main", block, "node", "label"))
    if not wide.isEmpty():
        apart = _keep(rows.join(wide, "key", "left_semi").select("node", "label").dropDuplicates(["node"]))
        sets = _keep(_sets(apart.select("node"), docs, nodes, width).join(apart.select("node"), "node", "left_semi"))
        again = _rarest(sets, bands.percent).join(apart, "node")
        of_key = again.groupBy("key").agg(F.min("label").alias("main"), F.max("label").alias("high"), F.ceil(F.count("*") / BLOCK).alias("many"))
        again = again.join(of_key.filter("main <> high").drop("high"), "key")
        sides = sides.unionByName(_sides(_keep(again.select("key", "main", block, "node", "label"))))
    sides = _keep(sides)
    release(rows)
    return sides


def _open_pairs(sides: DataFrame, nodes: DataFrame, labels: DataFrame, bands: Bands, first: int, last: int | None) -> DataFrame:
    """Pairs (a, b) of a run that short fingerprints allow and that aren't in one component by now: of the members a stray may link
    with, in the order of the fingerprints' difference, those from `first` on and before `last`.

    Sides keep the components they were dealt by, so the order is the same in every call. Their fingerprints are many times as long as
    the rest of a side, and are only looked up here.
    """
    of_node = nodes.select("node", "n", "short").join(labels.select("node", F.col("label").alias("now")), "node", "left")
    sides = sides.join(of_node.withColumn("now", F.coalesce("now", "node")), "node")
    ordered = sides.repartition("run").sortWithinPartitions("run", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        def handle(columns: dict, *_) -> pa.RecordBatch:
            side, node, label, n, prints, now = (columns[x] for x in ("side", "node", "label", "n", "short", "now"))
            allowed = np.array([bands.difference(i) for i in range(2 * int(n.max()) + 1)])
            starts = starts_of(columns["run"])
            found = []
            for start, end in zip(starts, np.append(starts[1:], len(side))):
                middle = start + int(np.searchsorted(side[start:end], 1))
                found += _alike(label, n, prints, allowed, np.arange(middle, end), np.arange(start, middle), first, last)
            i, j = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            apart = now[i] != now[j]
            a, b = node[i[apart]], node[j[apart]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        yield from sorted_runs(batches, "run", handle)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _alike(label, n, prints, allowed, strays, members, first: int, last: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of strays and of members with other labels whose sizes and fingerprints allow a link; of each stray's partners, which come
    by difference and then in order, the first-th to the last-th (of each size of fingerprint)."""
    out = []
    cells = np.array([len(prints[i]) for i in (*strays, *members)])
    of_strays, of_members = cells[: len(strays)], cells[len(strays) :]
    for p in set(of_strays.tolist()):
        for q in set(of_members.tolist()):
            i, j = strays[of_strays == p], members[of_members == q]
            x, y = (np.frombuffer(b"".join(prints[s].tolist()), np.uint8).reshape(len(s), -1) for s in (i, j))
            apart = least_difference(x, y).astype(np.int64)
            good = (apart <= allowed[n[i][:, None] + n[j][None, :]]) & (label[i][:, None] != label[j][None, :])
            if good.sum(axis=1).max(initial=0) <= first:
                continue
            order = np.argsort(np.where(good, apart, np.iinfo(np.int64).max), axis=1, kind="stable")[:, first:last]
            at = np.nonzero(np.take_along_axis(good, order, axis=1))
            out.append((i[at[0]], j[order[at]]))
    return out


def similar_groups(df: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row of df."""
    ship(df.sparkSession)
    bands = Bands(percent)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    wide = _keep(_nodes(docs, width, bands))
    sets = wide.filter("node IS NOT NULL")
    nodes = _keep(sets.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("short").alias("short")))
    rows = _keep(wide.drop("print", "short"))
    release(wide)
    n_buckets = 1 << min(64 - 8 * KEY_BYTES, max(10, (nodes.count() // NODES_PER_BUCKET).bit_length()))
    members = _keep(_members(docs, width, bands, n_buckets))
    pairs = members.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).filter("a <> b").distinct()
    pairs = _keep(_by_fingerprint(pairs, nodes, bands))
    links = _keep(_verified(pairs, docs, nodes, width, bands))
    labels = components(links)
    sides = _open_sides(members, labels, docs, nodes, width, bands)
    release(members)
    # a stray's likeliest partners first: once they have joined it, the others needn't be looked at, however many they are
    for first, last in ((0, LIKELIEST), (LIKELIEST, None)):
        more = _open_pairs(sides, nodes, labels, bands, first, last).join(pairs, ["a", "b"], "left_anti")
        more = _keep(_by_fingerprint(_keep(more), nodes, bands))
        if not more.isEmpty():
            links = links.unionByName(_keep(_verified(more, docs, nodes, width, bands)))
            labels = components(links)
    release(sides)
    release(pairs)
    labelled = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = labelled.select("node", "label").join(smallest, "label").select("node", "component_id")
    return rows.select("id", "node", F.col("n").alias("n_shingles")).join(of_node, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one_of_each(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns: of each group of similar documents the one with the smallest id.

    Rows that repeat an id and its text are one document and stay once; rows that repeat an id with other texts are documents of
    their own, told apart by the text's hash, which also breaks the tie. Rows without an id can't be told apart by it and all stay.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain, key, text = df.toDF(*names), names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    whole = plain.filter(F.col(key).isNotNull()).withColumn("h", F.xxhash64(text))
    groups = similar_groups(whole.select(F.struct(F.col(key).alias("id"), "h").alias("own"), text), width, percent, "own", text)
    # two columns: structs of nullable and other fields are cast, and after that the texts would be shuffled again to drop duplicates
    first = groups.filter("own = component_id").select(F.col("own.id").alias(key), "own.h").distinct()
    kept = whole.join(first, [key, "h"], "left_semi").dropDuplicates([key, "h"]).select(names)
    return kept.unionByName(plain.filter(F.col(key).isNull())).toDF(*df.columns)
