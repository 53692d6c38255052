"""The quality classifier against a plain version of its updates, and on rows it hasn't seen."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import quality, queries

DOCS, LABELS = "text string, doc_id long, label int, x double", "doc_id long, quality int, toxic int, text string"
SMALL = quality.Settings(buckets=1 << 10)


def plain_row(text, buckets):
    words = [crc32(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode().lower())]
    found = Counter(w % buckets for w in words)
    for a, b in zip(words, words[1:]):
        two = (a * 0x9E3779B1 + b * 0x85EBCA77) % 2**32
        two ^= two >> 15
        found[two * 0x2C1B3C6D % 2**32 % buckets] += 1
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in found.values())) or 1
    return {**{k: math.log1p(n) / norm for k, n in found.items()}, "bias": 1.0}


def plain_fit(rows, s):
    z, n = Counter(), Counter()

    def weight(k):
        shrunk = math.copysign(max(abs(z[k]) - s.l1, 0), z[k])
        return -shrunk / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, label in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / s.alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in n}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = rng.choice(["alpha", "beta", "Gämma", "delta", "x1"], rng.integers(1, 30))
        rows.append((i, " ".join(w if good or rng.random() < 0.5 else w + "###" for w in words), int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(t, i, 5, 0.5) for i, t, _ in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, y, 0, "other") for i, _, y in rows], LABELS)


def test_one_lane_equals_plain_updates(spark):
    rows = texts(1, 60) + [(100, None, 0), (101, "", 1), (102, " \n", 1)]
    docs, labels = frames(spark, rows)
    order = quality.examples(docs, labels, "doc_id", "text", "quality", 1000)
    order = order.select("id", F.xxhash64(F.lit("order"), "id", "h").alias("place")).collect()
    place = {r["id"]: r["place"] for r in order}
    assert len(place) == len(rows)
    learned = quality.fit(docs, labels, settings=SMALL)
    wanted = plain_fit([(plain_row(t, SMALL.buckets), y) for i, t, y in sorted(rows, key=lambda r: place[r[0]])], SMALL)
    for r in quality.score(docs, learned).collect():
        x = plain_row(next(t for i, t, _ in rows if i == r["doc_id"]), SMALL.buckets)
        score = 1 / (1 + math.exp(-sum(wanted.get(k, 0) * v for k, v in x.items())))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_labels_that_teach_nothing_and_repeated_rows(spark):
    rows = texts(2, 40)
    docs, labels = frames(spark, rows)
    learned = quality.fit(docs, labels, settings=SMALL, lane_rows=10)
    odd = [(0, None, 0, ""), (None, 1, 0, ""), (1, 7, 0, ""), (500, 1, 0, ""), (500, 0, 0, ""), (3, rows[3][2], 0, ""), (901, 0, 0, "")]
    more = docs.union(docs.limit(15)).union(spark.createDataFrame([("tie ###", 500, 0, 0.0), ("no id", None, 0, 0.0)], DOCS))
    again = quality.fit(more, labels.union(spark.createDataFrame(odd, LABELS)), settings=SMALL, lane_rows=10)
    assert np.allclose(learned, again, atol=1e-12)
    found = quality.score(more, again).collect()
    assert len(found) == 57 and len({(r["doc_id"], r["score"]) for r in found}) == 42


def test_without_examples_and_empty_tables(spark):
    docs, labels = frames(spark, texts(3, 5))
    learned = quality.fit(docs, labels.limit(0), settings=SMALL)
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, learned).collect()} == {(0.5, 1)}
    assert quality.score(docs.limit(0), learned).collect() == []
    assert (quality.fit(docs.limit(0), labels, settings=SMALL) == 0).all()


def test_the_sample_is_bounded_also_where_one_id_has_most_rows(spark):
    docs, labels = frames(spark, texts(4, 300))
    hot = spark.createDataFrame([(f"text number {i % 900}", 5, 0, 0.0) for i in range(1500)], DOCS)
    labels = labels.union(spark.createDataFrame([(5, 1, 0, "")] * 500, LABELS))
    for wanted in (100, 10**6):
        n = quality.examples(docs.union(hot), labels, "doc_id", "text", "quality", wanted).count()
        assert n == 1200 if wanted > 1200 else n < 200


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["ab", "Cd,", "e###", "été"], 400)).encode()
    whole = quality.counted(text, 512)
    monkeypatch.setattr(quality, "PIECE_BYTES", 50)
    pieces = quality.counted(text, 512)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert not len(quality.counted(b" " * 300, 512)[0])


def test_rows_not_seen(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.op13_quality(spark, SF)
    assert found.columns == ["doc_id", "score", "predicted", "held_out"]
    held = [(r["predicted"], r["score"], labels[r["doc_id"]]) for r in found.collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for _, s, y in held if y], [s for _, s, y in held if not y]
    assert len(good) > 40 and len(bad) > 5
    assert sum(p == y for p, _, y in held) / len(held) > 0.9
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.95
