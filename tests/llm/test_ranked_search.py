"""Ranked search against scoring every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, ranked_search
from tidemark.llm.common import keep

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    held = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms_of(t))
    found = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t]
            )
            if i is not None and score > 0:
                scored.append((-score, i))
        found += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found)


def corpus(seed, n=600, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Straße", "ÉTÉ", "été", "naïve", "X9"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda k: " ".join(rng.choice(vocabulary, k, p=weight / weight.sum()))
    docs = [(i, draw(rng.integers(1, 40))) for i in range(n)]
    docs += [(i + 2000, docs[5][1]) for i in range(120)] + docs[:10]  # a group of copies, repeated rows
    docs += [(3000, None), (3001, ""), (3002, "!? --"), (None, docs[7][1]), (3003, draw(30000)), (3004, " w1 w2 w1")]
    items = [(i, draw(rng.integers(1, 30))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unknown words"), (None, "w1 w2"), (3, "w40, W41!"), (103, docs[5][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(t, i, 1, "s") for i, t in docs], "text string, doc_id long, id int, terms string").repartition(3),
        spark.createDataFrame([(t, i, 1.0) for i, t in items], "text string, item_id long, score double"),
    )


@pytest.mark.parametrize("block_rows, max_pairs", [(50, 1 << 16), (400, 3), (64, 0)])
def test_equals_scoring_all(spark, block_rows, max_pairs, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_ROWS", 10)
    docs, items = corpus(block_rows)
    found = ranked_search.best_documents(*frames(spark, docs, items), top=20, block_rows=block_rows, max_pairs=max_pairs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain(docs, items, 20)


def test_other_ids_and_empty_tables(spark):
    docs, items = corpus(9, 80)
    df, asked = frames(spark, docs, items)
    text = df.withColumn("doc_id", df.doc_id.cast("string"))
    found = ranked_search.best_documents(text, asked, top=5)
    wanted = plain([(None if i is None else str(i), t) for i, t in docs], items, 5)
    assert sorted(map(tuple, found.collect())) == wanted
    assert ranked_search.best_documents(df.limit(0), asked).collect() == []
    assert ranked_search.best_documents(df, asked.limit(0)).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 7)
    text = "Ab cde, fghijklmnop ünïcode-9x  y" * 20
    assert [w.decode() for x in ranked_search.words(text.encode()) for w in x] == terms_of(text)


def test_joint_impacts(monkeypatch):
    monkeypatch.setattr(ranked_search, "PAIR_POSTINGS", 50)
    rng = np.random.default_rng(4)
    held = rng.random((12, 40)) < 0.3
    held[:, 0] |= ~held.any(axis=1)
    factor = rng.integers(1, 1000, held.shape)
    starts = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
    rows, factors = np.nonzero(held)[1], factor[held]
    a, b = np.array([(i, j) for i in range(12) for j in range(12) if i != j]).T
    w = rng.integers(1, 50, 12)
    docs, joint = ranked_search.joint_impacts(40, starts, rows, factors, a, b, w[a], w[b])
    for x, y, n, most in zip(a, b, docs, joint):
        both = held[x] & held[y]
        assert n == both.sum() and most == (w[x] * factor[x] + w[y] * factor[y])[both].max(initial=0)


def test_tasks_hold_few_blocks_at_a_time(spark, monkeypatch):
    """Every job with a Python function runs within the operator, with small batches, and reads blocks one by one."""
    held, whole = [], common.small_batches
    monkeypatch.setattr(common, "small_batches", lambda spark, most, rows=None: held.append((most, rows)) or whole(spark, most, rows))
    docs, items = corpus(6, 300)
    found = ranked_search.best_documents(*frames(spark, docs, items), top=5, block_rows=50)
    of_blocks = (ranked_search.BATCH_BYTES, 1)
    assert held == [(ranked_search.BATCH_BYTES, None)] * 2 + [of_blocks] * 4
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.orderBy("item_id", "rank").collect()] == plain(docs, items, 5)


def test_pair_bounds_are_tighter_and_still_bounds(spark):
    docs, items = corpus(2, 400)
    df, asked = frames(spark, docs, items)
    held = ranked_search.corpus(keep(ranked_search.invert(df, "doc_id", "text", 64)))
    weighted = keep(ranked_search.weigh(held, asked, "item_id", "text"))
    pairs = ranked_search.frequent_pairs(weighted)
    table = pa.Table.from_batches(ranked_search.index(held, pairs).toArrow().to_batches()).combine_chunks().to_batches()[0]
    queries = [(r["item"], [tuple(t) for t in r["terms"]], None) for r in weighted.collect()]
    known = {(x[0], x[1]): i for i, x in enumerate(pairs)}
    bounds, opened = {}, {}
    for name, own in (("pairs", known), ("single", {})):
        q = ranked_search.Queries(queries, own, 10)
        found = []
        for i in range(table.num_rows):
            place = {x: k for k, x in enumerate(table.column("terms")[i].as_py())}
            at = np.array([place.get(x, -1) for x in q.terms])
            found.append(q.bounds(at, *(ranked_search._values(table, c, i).astype(np.int64) for c in ("peaks", "pairs", "joint")))[:, -1])
        bounds[name] = np.array(found)
        opened[name] = sum(q.search(table, i) for i in range(table.num_rows))
    assert (bounds["pairs"] <= bounds["single"]).all() and (bounds["pairs"] < bounds["single"]).mean() > 0.3
    assert opened["pairs"] <= opened["single"]
    most = {item: score for item, rank, _, score in plain(docs, items, 1)}
    reached = {x[0]: bounds["pairs"][:, k].max() for k, x in enumerate(queries)}
    assert all(reached[item] >= score for item, score in most.items())
