"""Registered queries against their SQL, and every stage of the pipeline on its own input."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from checks.run import rows_by_name
from tidemark.llm import common, jaccard, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    answer = db.execute(queries.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(names, answer.fetchall())


def without_repeats(texts, length, words):
    """Every string of `length` bytes and every run of `words` words that starts at two places or more, removed one by one."""
    places, covers = defaultdict(int), []
    for i, text in texts.items():
        found = [m.span() for m in re.finditer(rb"[^ \t-\r]+", text)]
        for a, b in [(a, a + length) for a in range(len(text) - length + 1)] + [(x[0], y[1]) for x, y in zip(found, found[words - 1 :])]:
            places[hash(text[a:b])] += 1
            covers.append((i, a, b))
    gone = {i: bytearray(len(text)) for i, text in texts.items()}
    seen = defaultdict(set)
    for i, a, b in covers:
        seen[hash(texts[i][a:b])].add((i, a))
    for i, a, b in covers:
        if places[hash(texts[i][a:b])] > 1 and len(seen[hash(texts[i][a:b])]) > 1:
            gone[i][a:b] = b"x" * (b - a)
    return {i: bytes(x for x, g in zip(text, gone[i]) if not g).decode(errors="ignore") for i, text in texts.items()}


def test_empty_tables_and_ids_with_two_texts(spark):
    some = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, some, "en", "s", 0), (1, some, "en", "s", 0), (1, "an entirely different text of other words in it", "en", "s", 0), (2, some, "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, rows[2][1]), (1, some)]
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.keep(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, "en", None, 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "?!", "en", "s", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.keep(stage(spark, docs, SF), "test")
        seen[name] = docs
        if name == "language":
            assert docs.columns == columns
            assert docs.count() == before.count() - 3  # rows without letters go, all others stay
        elif name == "near_duplicates":
            groups = jaccard.similar_groups(before, 5, 80)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in groups.collect()})
            assert docs.count() < before.count() and docs.columns == columns
        elif name == "repeats":
            left = without_repeats({r["doc_id"]: r["text"].encode() for r in before.collect()}, 250, 51)
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == left
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) and docs.columns == columns
            assert sum(map(len, left.values())) < sum(len(r["text"]) for r in before.collect())
    pieces = seen["packing"]
    assert Counter(r["doc_id"] for r in pieces.collect()).keys() == {r["doc_id"] for r in seen["repeats"].collect()}
    whole = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert all(r["doc_tokens"] == whole[r["doc_id"]] for r in pieces.collect())


def test_repeated_passages_of_over_50_words_go(spark):
    chosen = random.Random(7)
    some = lambda n, low, high: [
        "".join(chosen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chosen.randint(low, high))) for _ in range(n)
    ]
    passages = [" ".join(some(51, low, high)) for low, high in ((1, 1), (2, 4), (4, 6), (8, 8))]
    assert [len(x) < 250 for x in passages] == [True, True, False, False] and len(passages[2]) < 400
    part = " ".join(passages[1].split(" ")[:50])  # 50 words of fewer than 250 bytes stay
    rows = []
    for i, passage in enumerate([*passages, part]):
        rows += [(10 * i + k, " ".join([*some(80, 3, 9), passage, *some(80, 3, 9)])) for k in range(2)]
    copies = [(100, " " + passages[0]), (101, " " + passages[0])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows + copies], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    before = dict(rows)
    for i, text in before.items():
        left = found[i]["text"]
        assert found[i]["n_chars"] == len(left)
        if i >= 40:
            assert left == text
            continue
        assert passages[i // 10] not in left
        # a letter or blank at either side may be equal by chance and go along in strings of bytes
        first, last = text.split(passages[i // 10])
        assert left in {first[: len(first) - a] + last[b:] for a in range(6) for b in range(6)}
    assert found[100]["text"].strip() == "" and found[101]["text"].strip() == ""
