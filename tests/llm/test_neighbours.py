"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from tidemark.llm import ann, topk

NAN, INF = float("nan"), float("inf")


def vectors(n, width, seed, ties=False):
    found = np.random.default_rng(seed).normal(size=(n, width))
    if ties:
        found = np.round(found)
    return found.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, id string")


def odd_rows(width):
    good = [1.0] * width
    return [(9001, None), (9002, [NAN] * width), (9003, [*good[1:], None]), (9004, [*good[1:], INF]), (9005, []), (9006, good + [1.0]), (None, good)]


def best(rows, query, own, k):
    scored = sorted((-int(np.floor(1024 * np.asarray(v, np.float64)) @ np.floor(1024 * query)), i) for i, v in rows if i != own)
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("ties", [False, True])
def test_exact_search(spark, ties):
    base = vectors(700, 8, 3, ties)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i + 700, base[i % 5].tolist()) for i in range(200)]
    df = frame(spark, rows + rows[:50] + odd_rows(8)).repartition(4)
    found = topk.top_k(df, df.filter("vec_id % 100 = 0 OR vec_id > 9000"), k=10, shard_rows=150, block_rows=3, leaf_rows=16).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 900, 100))
    for query, hits in by.items():
        wanted = best(rows, np.asarray(rows[query][1], np.float64), query, 10)
        assert [(i, s) for _, i, s in sorted(hits)] == wanted
        assert [rank for rank, _, _ in sorted(hits)] == list(range(1, 11))


def test_exact_search_in_small_tables(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (1, [0.0, 0.0])])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(two, two.filter("vec_id = 0"), 10).collect()] == [(0, 1, 0)]
    assert topk.top_k(two.limit(0), two, 10).collect() == []
    assert topk.top_k(two, two.limit(0), 10).collect() == []


def test_products_are_exact():
    big = np.array([[2**30, 2**30 + 1]], np.int64)
    assert topk.products(big, big)[0, 0] == 2**60 + (2**30 + 1) ** 2
    with pytest.raises(OverflowError):
        topk.products(big * 4, big * 4)


def test_a_box_bounds_its_rows():
    rows = np.floor(1024 * vectors(500, 6, 5)).astype(np.int64)
    tree = topk.KDTree(np.arange(500), rows, 16)
    queries = np.floor(1024 * vectors(20, 6, 6)).astype(np.int64)
    bounds = tree.bounds(queries)
    for node, inside in enumerate(tree.rows):
        assert (bounds[:, node][:, None] >= topk.products(queries, rows[inside])).all()


def test_approximate_search(spark):
    base = vectors(2500, 16, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(i + 3000, base[0].tolist()) for i in range(100)]
    df = frame(spark, rows + rows[:20] + odd_rows(16) + [(9007, [0.0] * 16)]).repartition(4)
    found = ann.nearest(df, df.filter("vec_id % 20 = 0 OR vec_id > 9000"), top=20, shard_rows=900, beam=64).collect()
    by, names = {}, np.array([i for i, _ in rows])
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    matrix = np.array([v for _, v in rows], np.float64)
    assert sorted(by) == sorted(i for i in names.tolist() if i % 20 == 0)
    hit = 0
    for query, hits in by.items():
        scores = matrix @ matrix[np.flatnonzero(names == query)[0]]
        order = [i for i in np.lexsort((names, -scores)) if names[i] != query][:20]
        hits = sorted(hits)
        assert [rank for rank, _, _ in hits] == list(range(1, 21)) and len({i for _, i, _ in hits}) == 20
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(hits, hits[1:]))
        hit += len({i for _, i, _ in hits} & set(names[order].tolist()))
    assert hit >= 0.9 * 20 * len(by)


def test_approximate_search_in_small_tables(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])])
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(two, two.filter("vec_id = 0"), 20).collect()] == [(0, 1, 20, 1.0)]
    assert ann.nearest(two.limit(0), two, 20).collect() == []
    assert ann.nearest(two, two.limit(0), 20).collect() == []
    one = two.filter("vec_id = 0")
    assert ann.nearest(one, one, 20).collect() == []


def test_all_points_are_found_where_the_beam_is_wide():
    points = ann.unit(vectors(60, 5, 1).astype(np.float64), 10.0)
    queries = np.concatenate((vectors(4, 5, 2), np.zeros((4, 1), np.float32)), axis=1)
    places, _ = ann.walk(points, np.full((60, 4), -1), queries, 64)
    places = places[:, :60]
    assert (places == np.argsort(-(queries @ points.T), axis=1, kind="stable")).all()


@pytest.mark.parametrize("clusters", [10, 50, 200, 380])
def test_every_cluster_of_a_full_shard_is_found(clusters):
    generator = np.random.default_rng(clusters)
    centres = generator.normal(size=(clusters, 32))
    base = centres[np.arange(8192) % clusters] + 0.1 * generator.normal(size=(8192, 32))
    points = ann.unit(base, float(np.linalg.norm(base, axis=1).max()))
    near, k = np.full((8192, 2 * ann.NEIGHBOURS), -1, np.int64), ann.NEIGHBOURS
    for low in range(0, 8192, 1024):
        scores = points[low : low + 1024] @ points.T
        scores[np.arange(1024), np.arange(low, low + 1024)] = -np.inf
        near[low : low + 1024, :k] = np.argpartition(-scores, k, axis=1)[:, :k]
    queries = np.concatenate((base[:200] / np.linalg.norm(base[:200], axis=1)[:, None], np.zeros((200, 1))), axis=1).astype(np.float32)
    places, _ = ann.walk(points, near, queries, ann.BEAM)
    wanted = np.argsort(-(queries @ points.T), axis=1, kind="stable")[:, :20]
    hit = sum(len(set(x) & set(y)) for x, y in zip(places[:, :20].tolist(), wanted.tolist()))
    assert hit >= 0.9 * wanted.size


def test_walks_start_in_every_part_of_a_graph():
    near = np.full((5000, 2), -1, np.int64)
    near[:, 0] = np.arange(5000) // 2 * 2 + 1 - np.arange(5000) % 2  # pairs
    entries = ann.entries_of(near, 160)
    assert len(entries) == len(set(entries.tolist())) and set((entries // 2).tolist()) == set(range(2500))
