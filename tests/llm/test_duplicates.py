"""Similar documents and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import components, jaccard, runs, suffix_dedup

SF = "/root/testdata/sf0.001"


def word_sets(rows, width):
    found = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        found[i] = {tuple(words)} if 0 < len(words) < width else set(zip(*[words[k:] for k in range(width)]))
    return found


def groups(rows, width, percent):
    sets = word_sets(rows, width)
    label = {i: i for i in sets}
    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def drifting(seed, n):
    """Families of texts, each copied from an earlier one with some words changed."""
    chosen = random.Random(seed)
    word = lambda: "".join(chosen.choice("abcdefgh") for _ in range(chosen.randint(1, 6)))
    out = []
    for i in range(n):
        if out and chosen.random() < 0.75:
            words = chosen.choice(out)[1].split(" ")
            for _ in range(chosen.randint(0, 3)):
                words[chosen.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(chosen.choice([1, 2, 4, 9, 20, 60, 200]))]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_groups_of_similar_texts(spark, width, percent):
    rows = drifting(4, 260) + [(300, None), (301, ""), (302, " \n"), (303, "Aé b"), (304, "aé  B"), (305, "x " * 20_000), (306, "x " * 20_001)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, node int, id int").repartition(5)
    found = jaccard.similar_groups(df, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == groups(rows, width, percent)
    kept = jaccard.keep_one_of_each(df, width, percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x for _, x in groups(rows, width, percent).values()})


def test_linked_sets_share_a_key():
    generator = np.random.default_rng(0)
    for percent in (80, 90, 95):
        bands, tried = jaccard.Bands(percent), 0
        while tried < 600:
            n = int(np.exp(generator.uniform(0, 6)))
            first = generator.integers(0, 2**63, n).astype(np.uint64)
            gone = int(generator.integers(0, bands.difference(2 * n) + 1))
            new = next(x for x in range(n, -1, -1) if x == 0 or 100 * (n - gone) >= percent * (n + x))
            second = np.unique(np.concatenate((first[gone:], generator.integers(0, 2**63, new).astype(np.uint64))))
            first = np.unique(first)
            both = len(np.intersect1d(first, second))
            union = len(first) + len(second) - both
            if both == union or 100 * both < percent * union:
                tried += both == union
                continue
            tried += 1
            keys = [jaccard.index_keys(x, bands) for x in (first, second)]
            assert len(np.intersect1d(*keys)), (percent, len(first), len(second))
            prints = [np.frombuffer(jaccard.fingerprint(x, bands), np.uint8)[None] for x in (first, second)]
            assert jaccard.least_difference(*prints)[0, 0] <= union - both


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (1, "other words in here"), (None, "a b c d e"), (None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.similar_groups(df, 3, 90).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter({(1, 1): 3, (2, 1): 1, (None, 1): 1, (None, None): 1})
    assert jaccard.similar_groups(df.limit(0)).collect() == []
    assert jaccard.keep_one_of_each(df.limit(0)).collect() == []


def test_sides_do_not_grow_with_the_number_of_tasks(spark, monkeypatch):
    """Members of a key come in blocks by the key's size; blocks by task would bring every stray to each of them."""
    chosen, counts = random.Random(11), []
    word = lambda: "".join(chosen.choice("abcdefghijkl") for _ in range(6))
    common = [word() for _ in range(100)]
    rows = [(i, " ".join(common + [word() for _ in range(60)])) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard._open_sides
    monkeypatch.setattr(jaccard, "_open_sides", lambda *x: (sides := whole(*x), counts.append(sides.count()))[0])
    for tasks in (1, 24):
        found = jaccard.similar_groups(df.repartition(tasks), 3, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == groups(rows, 3, 80)
    assert counts[0] == counts[1] > 1000


def test_packed_keys():
    generator = np.random.default_rng(3)
    for bits in (10, 11, 24):
        low = 64 - bits - 8 * jaccard.KEY_BYTES
        for bucket in (0, 5, (1 << bits) - 1):
            below = np.sort(generator.integers(0, 1 << 8 * jaccard.KEY_BYTES, 300, dtype=np.uint64))
            keys = ((below + np.uint64(bucket << 8 * jaccard.KEY_BYTES)) << np.uint64(low)).view(np.int64)
            planes = jaccard._packed(keys, low)
            assert len(planes) == 300 * jaccard.KEY_BYTES
            assert jaccard._unpacked(planes, bucket, low).tolist() == keys.tolist()


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "z")], "doc_id long, text string, lang string")
    kept = jaccard.keep_one_of_each(df)
    plan = kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search(r"SortAggregate.* first\(.*\n.*Sort.*\n.*Exchange", plan) and "partial_first(" in plan
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_keys_of_many_unlike_sets(spark, monkeypatch):
    """Half of every text is the same, so many keys are shared by sets that are not alike."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    chosen = random.Random(9)
    word = lambda: "".join(chosen.choice("abcdefghijkl") for _ in range(6))
    common, rows = [word() for _ in range(100)], []
    for i in range(60):
        words = common + [word() for _ in range(100)]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            words[150] = word()
            rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard.similar_groups(df, 3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == groups(rows, 3, 90)
    sets = jaccard.shingles([t.encode() for _, t in rows], 3)
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for (i, _), x in zip(rows, sets)], "node long, items binary")
    met = jaccard._rarest(sets, 90).groupBy("key").agg({"node": "collect_list"}).collect()
    assert {tuple(sorted(r[1])) for r in met} == {(i, 100 + i) for i in range(0, 60, 10)}  # unlike sets don't meet


def test_strays_are_cut_into_blocks(spark):
    rows = spark.range(6000).selectExpr("7L AS key", "-1L AS main", "id AS node", "id AS label", "id div 512 AS block", "9L AS n", "X'00' AS short")
    runs = jaccard._sides(rows).groupBy("run").pivot("side", [0, 1]).count().collect()
    assert len(runs) == 12 * 12 and max(r["1"] for r in runs) < 2 * 512 and max(r["0"] for r in runs) <= 512
    assert sum(r["0"] * r["1"] for r in runs) == 6000**2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (200, 202), (201, 202)]
    found = components.components(spark.createDataFrame(chain, "a long, b long"))
    wanted = {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 201: 200, 202: 200}
    assert {r["node"]: r["label"] for r in found.collect()} == wanted


def without(rows, length):
    """What is left of each text, byte by byte."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def patched(seed, alphabet, n, tail):
    chosen = random.Random(seed)
    some = lambda k: "".join(chosen.choice(alphabet) for _ in range(k))
    pool = [some(chosen.randint(20, 200)) for _ in range(20)]
    part = lambda: chosen.choice(pool)[chosen.randint(0, 30) : chosen.randint(30, 200)]
    rows = [(i, "".join(part() if chosen.random() < 0.5 else some(chosen.randint(0, tail)) for _ in range(chosen.randint(0, 8)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, "a" * 500), (n + 4, "ab" * 300), (n + 5, "é" * 200), (n + 5, "é" * 200 + "x")]


@pytest.mark.parametrize("alphabet, tail, length, phrase", [("abcdefghé ", 100, 40, 6), ("ab", 60, 40, 6), ("abcdefghijklmno", 200, 60, 10)])
def test_repeated_strings(spark, alphabet, tail, length, phrase):
    rows = patched(3, alphabet, 120, tail)
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, k int").repartition(5)
    found = suffix_dedup.mark_repeats(df, length, phrase=phrase).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == without(rows, length)


def test_repeated_strings_of_blocks_too_long_for_one_go(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 2)
    monkeypatch.setattr(suffix_dedup, "GO_ROWS", 2)
    rows = patched(5, "abcdefghé ", 120, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.mark_repeats(df, 40, phrase=6).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == without(rows, 40)


def test_long_runs_are_put_together_once():
    blocks = [[1, 1, 2], [2, 2], [2], [], [2, 3], [4], [4, 4]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], names=["key"]) for x in blocks]
    found = [(x["key"].tolist(), first, last) for x, first, last in runs.whole_runs(iter(batches), "key")]
    assert found == [([1, 1], True, False), ([2, 2, 2, 2, 2], False, False), ([3], False, False), ([4, 4, 4], False, True)]


def test_repeats_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    found = suffix_dedup.mark_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == without(rows, 400)


def test_rows_without_their_repeats(spark):
    shared = "".join(random.Random(1).choice("abcdefgh é") for _ in range(450))
    rows = [(1, "first " + shared + " end", 9, None), (2, "second one " + shared, 9, "k"), (3, None, 9, "k"), (4, "short", 9, "k"), (5, "z" * 30, 9, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, k string")
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, 400, chars_col="n_chars").collect()}
    # what stands on both sides of the shared string goes along where it is equal
    assert found[1]["text"] == "first end" and found[1]["n_chars"] == 9
    assert found[2]["text"] == "second one" and found[3]["text"] is None and found[4]["text"] == "short"
    assert suffix_dedup.remove_repeats(df.limit(0), 400).collect() == []
    assert suffix_dedup.mark_repeats(df.limit(0)).collect() == []


def test_no_task_of_the_repeats_runs_two_python_functions(spark):
    """Each function of a task takes a worker process of its own, which stays with its memory."""
    text = "one and the same passage of some words and more of them " * 8
    df = spark.createDataFrame([(i, f"number {i} " * 20 + text + f" end {i}") for i in range(6)], "doc_id long, text string")
    plan = suffix_dedup.remove_repeats(df, length=100)._jdf.queryExecution().executedPlan().toString()
    functions = [part.count("MapInArrow") for part in plan.split("Exchange")]
    assert max(functions) == 1
